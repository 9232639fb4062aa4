"""Secret scans: fixed patterns, and strings that zstandard cannot explain from the code around them.

A candidate is a run of token characters with a sensitive word before, after or inside it (as in name=value, where the
value alone counts), or a run that follows or precedes such a run with nothing but line ends, blanks, quotes or joining marks
between: the lines of a key are one block, however many they are. Its novelty is the number of compressed bytes it adds under a dictionary of common identifiers and
the text on both sides. A run that
costs many bytes for its length is reported as a span of kind ``novel``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed by the contract of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: What makes a run sensitive, within CONTEXT characters of it or inside.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|credential|private|auth|bearer|access[_-]?key|login|signature|AKIA", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT = 64
#: What may stand between a sensitive word and the value in one run.
JOINT = re.compile(r"(?:[=_/-]*(?:key|id))?[=_/-]+", re.I | re.A)
LEAST_RUN = 16
#: What may stand between two runs of one block.
BLOCK_GAP = re.compile(r"""[\s"'`,;+\\]*""")
#: Marginal compressed bits per character from which a run is reported, and the least bytes it must add.
BITS, LEAST = 4.3, 12

IDENTIFIERS = """
def class return import from for while if else elif try except finally with lambda self None True False
public private static void int string const let var function new this null undefined struct enum
username user_name user_id password passwd passphrase secret secret_key client_secret client_id token access_token
refresh_token auth_token bearer_token api_key apikey apiKey api_secret access_key access_key_id secret_access_key private_key
public_key signature credential credentials authorization authentication session_id cookie connection_string
getConfiguration setConfiguration getInstance createInstance initialize configuration environment variable
application_settings development production localhost example placeholder changeme your_password_here your_api_key_here
http:// https:// www. .com .org .net /usr/local/bin /etc/config /home/user/ abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
0123456789 00000000000000000000000000000000 ffffffffffffffffffffffffffffffff xxxxxxxxxxxxxxxxxxxxxxxx 1234567890abcdef
const char * std::string System.out.println console.log os.environ process.env config.get settings.get getenv
BEGIN PRIVATE KEY END PRIVATE KEY CERTIFICATE ssh-rsa sha256 base64 hexdigest encode decode utf-8
"""

Span = tuple[int, int, str]


class Scanner:
    def __init__(self, bits: float = BITS, least: int = LEAST, identifiers: str = IDENTIFIERS) -> None:
        self.bits, self.least, self.identifiers = bits, least, identifiers.encode()

    def novelty(self, around: str, run: str) -> int:
        """Compressed bytes that the run adds, with the identifiers and the text around it as dictionary."""
        known = zstandard.ZstdCompressionDict(self.identifiers + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compress = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress
        return len(compress(run.encode())) - len(compress(b""))

    def base(self, text: str) -> list[Span]:
        found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return found

    def value(self, run: str) -> int | None:
        """Where the value begins in a run that holds its own sensitive word, as in name=value; None without one."""
        at = None
        for word in SENSITIVE.finditer(run):
            joint = JOINT.match(run, word.end())
            if joint and len(run) - joint.end() >= LEAST_RUN:
                at = joint.end()
        return at

    def novel(self, text: str) -> list[Span]:
        if not SENSITIVE.search(text):
            return []
        runs = [(*m.span(), self.value(m[0])) for m in CANDIDATE.finditer(text)]
        near = [own is not None or bool(SENSITIVE.search(text, max(0, lo - CONTEXT), lo) or SENSITIVE.search(text, hi, hi + CONTEXT)) for lo, hi, own in runs]
        # what is said of one run of a block holds for the next, and for the one before
        same = [BLOCK_GAP.fullmatch(text, a[1], b[0]) is not None for a, b in zip(runs, runs[1:], strict=False)]
        for k, joined_on in enumerate(same):
            near[k + 1] |= joined_on and near[k]
        for k in range(len(same) - 1, -1, -1):
            near[k] |= same[k] and near[k + 1]
        found = []
        for (lo, hi, own), sensitive in zip(runs, near, strict=True):
            if not sensitive:
                continue
            lo += own or 0
            around = text[hi : hi + 4 * CONTEXT] + "\n" + text[max(0, lo - 4 * CONTEXT) : lo]
            added = self.novelty(around, text[lo:hi])
            if added >= self.least and 8 * added >= self.bits * (hi - lo):
                found.append((lo, hi, "novel"))
        return found

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind."""
        return ordered(self.base(text) + self.novel(text))


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: float = BITS, least: int = LEAST, identifiers: str = IDENTIFIERS) -> DataFrame:
    """Add secrets, an array of (start, end, kind) in code points, to the kept columns of each row.

    Whole texts are scanned; a null or empty text has no spans. Repeated rows give repeated results, and an empty table
    an empty one.
    """
    common.small_batches(df.sparkSession)
    kept, head = common.kept_names(df, keep, ["secrets"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def start():
        scan = Scanner(bits, least, identifiers)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in scan.spans(t or "")] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found, kind)], names=[*kept, "secrets"])

        return step

    return df.select(*keep, F.col(text)).mapInArrow(common.batches(start), head + "secrets array<struct<start: long, end: long, kind: string>>")


def op5_novelty(spark, sf_dir: str) -> DataFrame:
    """Spans of every document of documents, as counts and digests."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(n, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
