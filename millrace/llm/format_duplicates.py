"""Records that differ in formatting alone, one per group and counted, by an incremental ledger.

The canonical key of a record is a 128-bit hash of its function name, path and
code, each reduced to lower-case letters and digits after the entries of dict
literals and the keyword arguments of calls were put in order.  The ledger
holds key, copies and earliest id in hash buckets in a folder that outlives the
session; a batch is aggregated by key, joined to the matching buckets by a full
outer join, added and committed under its id.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import join_hot
from millrace.runtime import discard, scratch, stage

BUCKETS = 64
_PY = re.compile(
    r"""\#[^\n]*|\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"|\Z)|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|[()\[\]{},:]|(?<![=!<>:+\-*/%&|^~])=(?![=>])""",
    re.S,
)
_JS = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*+(?:`|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|[()\[\]{},:]|(?<![=!<>:+\-*/%&|^~])=(?![=>])""", re.S
)
_PYTHON = re.compile(r"(?mi)^\s*(?:async\s+)?def\s+\w+|^\s*(?:from\s+\S+\s+)?import\s+[\w.]+\s*(?:$|as\b|,|\()")
_DEFINING = {"def", "function", "class", "lambda"}
_NAME = re.compile(r"\s*\w+\s*$")
_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower-case letters and digits alone."""
    return _OTHER.sub("", text.lower())


class _Frame:
    __slots__ = ("bracket", "call", "parts", "entry", "colon", "equals")

    def __init__(self, bracket: str, call: bool):
        self.bracket, self.call = bracket, call
        self.parts: list[tuple[str, bool]] = []  # entry, whether it has a key of its own
        self.entry: list[str] = []
        self.colon = self.equals = False

    def close_entry(self) -> None:
        text = "".join(self.entry)
        if text.strip():
            self.parts.append((text, self.colon if self.bracket == "{" else self.equals))
        self.entry, self.colon, self.equals = [], False, False

    def text(self) -> str:
        self.close_entry()
        keyed = [t for t, k in self.parts if k]
        if len(keyed) > 1 and (self.bracket == "(" and self.call or self.bracket == "{" and len(keyed) == len(self.parts)):
            ordered = iter(sorted(keyed, key=plain))
            return ",".join(next(ordered) if k else t for t, k in self.parts)
        return ",".join(t for t, _ in self.parts)


def _back(code: str, at: int, of) -> int:
    while at and of(code[at - 1]):
        at -= 1
    return at


def _is_call(code: str, at: int) -> bool:
    """Whether the parenthesis at ``at`` holds the arguments of a call, by the words before it, however long they are."""
    stop = _back(code, at, str.isspace)
    if not stop or not (code[stop - 1].isalnum() or code[stop - 1] in "_)]$"):
        return False
    word = lambda c: c.isalnum() or c in "_$"
    start = _back(code, stop, word)
    if code[start:stop].lower() in _DEFINING:
        return False
    end = _back(code, start, str.isspace)
    if end and code[end - 1] == "*":
        end = _back(code, end - 1, str.isspace)
    return code[_back(code, end, word) : end].lower() not in _DEFINING


def canonical_code(code: str) -> str:
    """The code's letters and digits in lower case, entries of dict literals and keyword arguments in order."""
    lex = _PY if _PYTHON.search(code) else _JS
    stack = [_Frame("", False)]
    last = 0
    for m in lex.finditer(code):
        a, b = m.span()
        c = code[a]
        top = stack[-1]
        if b - a > 1 or c not in "()[]{},:=":
            continue
        if c in "([{":
            top.entry.append(code[last:a])
            stack.append(_Frame(c, c == "(" and _is_call(code, a)))
        elif c in ")]}":
            top.entry.append(code[last:a])
            if len(stack) > 1:
                stack.pop()
                stack[-1].entry.append(" " + top.text() + " ")
        elif c == ",":
            if top.bracket:
                top.entry.append(code[last:a])
                top.close_entry()
            else:
                top.entry.append(code[last:b])
        elif c == ":":
            top.entry.append(code[last:b])
            top.colon = True
        else:
            if top.bracket == "(" and not top.entry and _NAME.match(code[last:a]):
                top.equals = True
            top.entry.append(code[last:b])
        last = b
    stack[-1].entry.append(code[last:])
    while len(stack) > 1:  # unbalanced: what is open stays as it stands
        top = stack.pop()
        top.call, top.bracket = False, ""
        stack[-1].entry.append(top.text())
    return plain("".join(stack[0].entry))


def _keys():
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for name, path, code in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                h = xxhash.xxh3_128()
                for part in (plain(name or ""), plain(path or ""), canonical_code(code)):
                    h.update(part.encode("utf-8", "surrogatepass"))
                    h.update(b"\x00")
                keys.append(h.digest())
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary())], schema=schema)

    return run, "id bigint, key binary"


def canonical_keys(df: DataFrame, id_col: str, name_col: str, path_col: str, code_col: str) -> DataFrame:
    """``(id, key)`` of the records whose code is not null; a null name or path counts as empty."""
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(name_col).alias("name"), F.col(path_col).alias("path"), F.col(code_col).alias("code")).where("code is not null")
    run, kind = _keys()
    return source.mapInArrow(run, kind)


class Ledger:
    """Copies and earliest id of every canonical key, kept in a folder by hash bucket.

    ``folder/data/<batch>/bucket=<n>`` holds the buckets that a batch changed,
    ``folder/commits/<version>.json`` which of them are current and the batches
    taken in.  A batch reads and rewrites the buckets of its own keys alone.
    Nothing counts before its commit is written, so a batch that broke off can
    be added again; a batch whose id was committed changes nothing.  Two writers
    cannot commit the same version: the later one fails and may add again.
    The number of buckets is fixed when the folder is first used.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._state = self._load() or {"version": 0, "buckets": buckets, "at": {}, "batches": []}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> dict | None:
        fs, p = self._fs(f"{self.folder}/commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        versions = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not versions:
            return None
        fs, p = self._fs(f"{self.folder}/commits/{versions[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        name = f"{self.folder}/commits/{state['version']:012d}"
        fs, draft = self._fs(f"{name}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        _, final = self._fs(f"{name}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("another batch was committed meanwhile; load the ledger and add again")
        self._state = state

    @property
    def batches(self) -> list[str]:
        return list(self._state["batches"])

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """``(bucket, key, copies, first_id)`` of all buckets, or of those named."""
        at = {int(b): f for b, f in self._state["at"].items() if buckets is None or int(b) in buckets}
        kind = "key binary, copies bigint, first_id bigint, bucket int"
        if not at:
            return self.spark.createDataFrame([], kind).select("bucket", "key", "copies", "first_id")
        parts = None
        for f in sorted(set(at.values())):
            base = f"{self.folder}/data/{f}"
            part = self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/bucket={b}" for b, g in sorted(at.items()) if g == f])
            parts = part if parts is None else parts.unionByName(part)
        return parts.select("bucket", "key", "copies", "first_id")

    def add(self, keys: DataFrame, batch_id: str) -> None:
        """Take in a batch ``(id, key)``; an id that was taken in before, and an empty batch, change no count."""
        if batch_id in self._state["batches"]:
            return
        bucket = F.pmod(F.xxhash64("key"), F.lit(self._state["buckets"])).cast("int")
        batch = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("bucket", bucket)
        batch = stage(batch, "ledger-batch")
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets
        at = dict(self._state["at"])
        if touched:
            name = uuid.uuid4().hex
            old = self.rows(touched)
            new = old.join(batch, ["bucket", "key"], "full").select(
                "bucket", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "first").alias("first_id")
            )
            new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
            at.update({str(b): name for b in touched})
        self._commit(self._state | {"version": self._state["version"] + 1, "at": at, "batches": [*self._state["batches"], batch_id]})
        discard(batch)

    def clean(self) -> None:
        """Delete the data folders that no bucket reads any more."""
        fs, p = self._fs(f"{self.folder}/data")
        current = set(self._state["at"].values())
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f.getPath().getName() not in current:
                fs.delete(f.getPath(), True)


def copies(df: DataFrame, id_col: str, name_col: str, path_col: str, code_col: str, *, folder: str | None = None, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """The ledger after all records, and ``(first_id, id)`` of each of these records that is a copy of an earlier id.

    The records are added in ``batches`` deliveries by id.  ``folder`` names a
    lasting ledger; without it one is made for this call in the shared folder.
    Records of null code are in no group.
    """
    spark = df.sparkSession
    keys = stage(canonical_keys(df, id_col, name_col, path_col, code_col), "copy-keys")
    ledger = Ledger(spark, folder or scratch(spark, "copy-ledger"))
    for i in range(batches):
        ledger.add(keys.where(F.pmod("id", F.lit(batches)) == i), f"delivery {i + 1} of {batches}")
    ledger.clean()
    rows = ledger.rows()
    several = stage(rows.where(F.col("copies") > 1).select("key", "first_id"), "copy-groups")
    return rows, join_hot(keys, several, ["key"]).where("id <> first_id").select("first_id", "id")
