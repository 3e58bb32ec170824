"""Secret scans: fixed patterns, and strings in a sensitive context that a primed compressor finds new.

The context of a candidate is its line and the one before, up to 256 characters away. Its novelty is what it adds to the compressed size of the text around it, under a dictionary of
identifiers: words, names and repeated strings add little, keys and tokens add nearly their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")
_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[\x20_-]?key|private|credential|bearer|authorization|signature|access[\x20_-]?key", _FLAGS)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]+)*")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY[A-Z ]*)-----")
KEY_LINES = re.compile(r"(?:\s*[A-Za-z0-9+/]{16,}={0,2}(?!\S))+(?:\s+[A-Za-z0-9+/]{1,15}={1,2}(?!\S))?")
_AROUND = 256
#: What stands right before, or begins, an encoded string that says what it is: a digest or a file's bytes.
PUBLIC = re.compile(r"""(?:\b(?:sha-?(?:1|224|256|384|512)|md5|blake[23][bs]?|integrity|checksum|digest|etag|fingerprint|ssh-(?:rsa|ed25519))["']?[-:=\s"'\x20]{1,4}|;base64,)$""", _FLAGS)
DIGEST = re.compile(r"(?:sha(?:1|224|256|384|512)|md5)[-_:=]", _FLAGS)
#: First characters of base64 for PNG, JPEG, GIF, ZIP, PDF, WOFF, WebP, SVG and XML files: fixed values.
FILES = ("iVBORw0KGgo", "/9j/", "R0lGOD", "UEsDB", "JVBERi", "d09GR", "UklGR", "PHN2Zy", "PD94bWw")
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", _FLAGS)
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://|www\.|(?<![a-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/", _FLAGS)
ONE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Priming text: identifiers and words usual in code and configuration.
IDENTIFIERS = """
abstract access account action address admin alias amount api application argument array async attribute auth
authorization authentication backend base64 bearer binary block body boolean branch bucket buffer build button byte
cache call category channel character charset check child class client cluster code collection color column command
comment commit component config configuration connect connection const constant constructor container content context
continue controller cookie copy count create created credential currency current cursor customer dashboard data
database date datetime debug default delete dependency description destination development device digest directory
disable display document domain double download driver duration element email enable encoding encrypt encryption
endpoint engine entity entry enum environment error event example exception execute expire expires export expression
extend external factory false field file filter final finally first float folder footer format forward frame function
gateway generate generic global group handle handler hash header height hidden host hostname http https identifier
identity image implement import include index information init initialize inline input insert instance integer
interface internal invalid invoice item iterator key keyword label language last layer layout length level library
license limit link list listener load local locale location lock log logger login long manager map master match
maximum member memory menu message metadata method middleware minimum mobile mode model module monitor month mutable
name namespace network node none notification null number object offset open operation operator option optional order
organization origin output override owner package page parameter parent parse partition passphrase password path
pattern payload payment performance permission phone pipeline platform plugin pointer policy pool port position post
prefix previous price primary print private process product production profile program project promise property
protected protocol provider proxy public publish query queue random range read reason receive record redirect
reference refresh region register release remote remove render replace report repository request required reset
resource response result return role root route router rule runtime sample save scale schedule schema scope screen
script search second secret section security select sequence serial server service session setting settings share
signature size socket sort source spec stack standard start state static status step stop storage store stream
string struct style subject submit subscribe subscription success suffix summary super switch symbol sync system table
tag target task template tenant test text theme thread time timeout timestamp title token total trace transaction
transfer transform trigger true type undefined unique unit update upload url user username utils uuid valid validate
validation value variable vector vendor version view virtual visible volume warning web webhook widget width window
worker workflow workspace write xml yaml zone src main java javascript python daily weekly monthly yearly module parser abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
access_key = "" api_key = "" client_secret = "" password = "" private_key = "" refresh_token = "" secret = "" token = ""
"""


class Novelty:
    """Bytes that a string adds to the compressed size of its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Added bytes a byte of ``text[start:end]``, beside what stands before and after it."""
        before, after, own = text[max(0, start - _AROUND) : start], text[end : end + _AROUND], text[start:end]
        near = (before + " " + after).encode("utf-8", "surrogatepass")
        return (len(self.size.compress(near + b" " + own.encode())) - len(self.size.compress(near))) / len(own)


@lru_cache(maxsize=2)
def novelty(identifiers: str) -> Novelty:
    return Novelty(identifiers)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of what the fixed patterns find, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the body of each private key block; without its END line, of the key lines after BEGIN."""
    out = []
    for m in BEGIN.finditer(text) if "PRIVATE KEY" in text else ():
        following = text.find("-----BEGIN ", m.end())
        end = text.find(f"-----END {m[1]}-----", m.end(), following if following >= 0 else len(text))
        body = text[m.end() : end] if end >= 0 else ""
        # Key lines fill most of a block; a text that only names both marks is none.
        if 2 * sum(len(c) for c in CANDIDATE.findall(body)) <= len("".join(body.split())):
            lines = KEY_LINES.match(text, m.end())
            body = lines.group() if lines else ""
        if body.strip():
            at = m.end() + len(body) - len(body.lstrip())
            out.append((at, at + len(body.strip())))
    return out


_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")
_DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?:[T_][0-9]{2}[-:]?[0-9]{2}(?:[-:]?[0-9]{2})?Z?)?(?![0-9])")


@lru_cache(maxsize=2)
def letter_pairs(identifiers: str) -> dict[str, float]:
    """Bits of a letter after another in the words of ``identifiers``; the empty key is for pairs that never occur."""
    pairs, firsts = Counter(), Counter()
    for word in re.findall("[a-z]{3,}", identifiers.lower()):
        for p in map("".join, zip(word, word[1:], strict=False)):
            pairs[p] += 1
            firsts[p[0]] += 1
    return {p: -math.log2((n + 0.1) / (firsts[p[0]] + 2.6)) for p, n in pairs.items()} | {"": 8.0}


def wordlike(s: str, identifiers: str = IDENTIFIERS) -> bool:
    """Whether three quarters of a string are words, numbers of up to four digits between marks, or a date and time.

    A word is four letters or more in one case, after a capital maybe, whose pairs of letters are usual ones.
    """
    bits, n, known = letter_pairs(identifiers), 0, 0
    for m in _DATE.finditer(s):
        known += m.end() - m.start()
    rest = _DATE.sub(lambda m: "-" * len(m.group()), s)
    for m in _WORD.finditer(rest):
        t, k = m.group(), m.end() - m.start()
        n += k
        if t.isdigit():
            alone = not (m.start() and rest[m.start() - 1].isalpha()) and not (m.end() < len(rest) and rest[m.end()].isalpha())
            known += k * (k <= 4 and alone)
        elif k >= 4:
            low = t.lower()
            known += k * (sum(bits.get(low[i : i + 2], bits[""]) for i in range(k - 1)) <= 5.0 * (k - 1))
    return known >= 0.75 * (n + sum(m.end() - m.start() for m in _DATE.finditer(s)))


def spoken_for(text: str, start: int, end: int, words: list[int]) -> bool:
    """Whether a sensitive word (``words`` has their starts) stands near ``text[start:end]``: in its line or the one before, at most
    256 characters away. For a part of an address it must be within the address."""
    line = text.rfind("\n", max(0, start - _AROUND), start)
    first = start - _AROUND if line < 0 else max(start - _AROUND, text.rfind("\n", max(0, start - _AROUND), line) + 1)
    after = text.find("\n", end, end + _AROUND)
    last = end + _AROUND if after < 0 else after
    before = text[max(0, start - _AROUND) : end].split()[-1]
    at = ADDRESS.search(before)
    if at:
        first, last = end - len(before) + at.end(), end
    k = bisect_left(words, first)
    return k < len(words) and words[k] < last


def public(text: str, start: int, end: int) -> bool:
    """Whether a string says itself that it is no secret: a digest, a file's bytes, a UUID, or one word of any language."""
    s = text[start:end]
    return bool(s.startswith(FILES) or DIGEST.match(s) or UUID.fullmatch(s.strip("/=+_-")) or ONE_WORD.fullmatch(s.strip("/=+_-")) or PUBLIC.search(text[max(0, start - 24) : start]))


def novel_spans(text: str, base: list[tuple[int, int, int, int]], measure: Novelty, least: float) -> list[tuple[int, int, int, int]]:
    """Private key blocks, and candidates that no base span covers, with a sensitive word near them and a novelty of at least ``least``.

    A candidate has 16 characters or more and a letter, is not public(), and is not made of words, since the compressor knows few
    of a language's words. What dots join to a novel candidate belongs to it up to the last candidate, and all of it if it
    starts as encoded JSON does. Lines are only compressed where a word is near, so long encoded texts cost a search.
    """
    words = [m.start() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    blocks = key_blocks(text)
    out = [(a, 3, e, a) for a, e in blocks]
    covers, k, reach = sorted([(a, e) for a, _, e, _ in base] + blocks), 0, 0

    def novel(m: re.Match) -> bool:
        s, at = m.group(), m.span()
        return bool(re.search("[A-Za-z]", s)) and spoken_for(text, *at, words) and not public(text, *at) and measure(text, *at) >= least and not wordlike(s)

    for run in RUN.finditer(text):
        start = None
        for m in CANDIDATE.finditer(text, run.start(), run.end()):
            while k < len(covers) and covers[k][0] <= m.start():
                reach, k = max(reach, covers[k][1]), k + 1
            if reach <= m.start() and start is None and novel(m):
                start = m.start()
            last = m.end()
        if start is not None:
            whole = text.startswith("eyJ", run.start())
            start, last = (run.start(), run.end()) if whole else (start, last)
            out.append((start, 3, last, start))
    return sorted(out)


def scan(docs: DataFrame, least: float = 0.5, identifiers: str = IDENTIFIERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, found (array of kind, start, end, secret_start), and the columns named in ``keep``, for each row.

    Positions are code points of the whole text, ends exclusive; ``found`` is by start, then kind in KINDS order. A
    null or empty text has no span; repeated rows get equal spans; other columns are left out. There is no shuffle.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = novelty(identifiers)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text) if text else []
                more = novel_spans(text, base, measure, least) if text else []
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "secret_start": v} for s, k, e, v in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, kind)], [*batch.schema.names[1:], "found"])

    first = [c for c in docs.columns if c in ("doc_id", *keep)]
    base = docs.select(F.col("text").cast("string").alias("__text"), *first)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"{kinds}, found array<struct<kind:string,start:bigint,end:bigint,secret_start:bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans and all spans as text, beside doc_id."""
    base = F.filter("found", lambda s: s["kind"] != "novel")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<secret>", least: float = 0.5) -> DataFrame:
    """``docs`` with each secret in text replaced by ``mark`` and n_chars, if there is one, counted again.

    Of an assignment only the value goes. Overlapping spans are one. All rows stay, and texts without a secret are
    unchanged; a null text stays null.
    """

    bounded_batches(docs.sparkSession)

    def clean(text: str | None, measure: Novelty) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted((v, e) for _, _, e, v in base + novel_spans(text, base, measure, least))
        out, at = [], 0
        for s, e in spans:
            if e > at:
                if s >= at:
                    out += [text[at:s], mark]
                at = e
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = novelty(IDENTIFIERS)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([clean(t, measure) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
