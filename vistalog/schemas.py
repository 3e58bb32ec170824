"""Schemas of source documents and scene tables; nothing is inferred."""

from __future__ import annotations

FRAME = "struct<frameId:string,timestampUs:bigint,channel:string,modality:string,uri:string,sequenceId:string,sensorId:string>"
CALIBRATION = "struct<calibrationId:string,sensorId:string,channel:string,modality:string,translation:array<double>,rotation:array<double>,cameraIntrinsic:array<array<double>>>"
POSE = "struct<egoPoseId:string,timestampUs:bigint,translation:array<double>,rotation:array<double>>"
RAW_LOG = f"rawLogId string, datasetId string, datasetVersion string, frames array<{FRAME}>, calibrations array<{CALIBRATION}>, egoPoses array<{POSE}>"
_SAMPLE = "struct<sampleId:string,timestampUs:bigint,frameIndex:bigint,sensorFrames:array<struct<frameId:string,channel:string,modality:string,timestampUs:bigint,uri:string,calibrationId:string,egoPoseId:string>>>"
SCENE = f"sceneId string, datasetId string, datasetVersion string, channels array<string>, sampleCount bigint, frameCount bigint, annotationCount bigint, hasGroundTruth boolean, samples array<{_SAMPLE}>"
PREDICTIONS = "dataset_id string, dataset_version string, scene_id string, sample_id string, predictions array<struct<prediction_id:string,category_name:string,translation:array<double>,size:array<double>,rotation:array<double>,score:double,lifting_status:string>>"
SOURCE = {
    "scene": "token string, name string, description string, first_sample_token string",
    "sample": "token string, scene_token string, timestamp long, next string, data map<string,string>, anns array<string>",
    "sample_data": "token string, timestamp long, filename string, calibrated_sensor_token string, ego_pose_token string, width int, height int, fileformat string, is_key_frame boolean",
    "sample_annotation": "token string, sample_token string, category_name string, instance_token string, translation array<double>, size array<double>, rotation array<double>, attribute_tokens array<string>, num_lidar_pts long, num_radar_pts long, visibility_token string",
    "calibrated_sensor": "token string, sensor_token string, translation array<double>, rotation array<double>, camera_intrinsic array<array<double>>",
    "sensor": "token string, channel string, modality string",
    "ego_pose": "token string, timestamp long, translation array<double>, rotation array<double>",
    "attribute": "token string, name string",
}
