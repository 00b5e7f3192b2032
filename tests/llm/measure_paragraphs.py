"""What paragraph MinHash banding finds of the exact result of p10_spans: ``python tests/llm/measure_paragraphs.py FOLDER [BANDS ROWS]``.

Paragraphs are cut at blank lines, signatures are minima of permuted hashes of
their character 12-grams, and paragraphs that agree in a band of another
document collide.  Counted is an upper bound: every exact stretch, or part of
one, that lies in a colliding paragraph counts as found.
"""

import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from millrace.llm import vec
from millrace.runtime import table


def paragraphs(text):
    at = 0
    for m in re.finditer(r"\n[ \t\r]*\n\s*|\Z", text):
        if m.start() - at >= 40:
            yield at, m.start()
        at = m.end()


def main(folder, bands=32, rows=2, k=12):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").select("doc_id", "text").collect() if r.text}
    exact = defaultdict(list)
    for r in entry.queries()["p10_spans"](spark, folder).collect():
        exact[r.doc].append((r.start, r.stop))
    buckets, where = [defaultdict(list) for _ in range(bands)], []
    for doc, text in texts.items():
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        for a, b in paragraphs(text):
            h = np.zeros(b - a - k + 1, np.uint64)
            for i in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + points[a + i : a + i + len(h)]
            h = np.unique(vec.mix(h))
            least = [int(vec.mix(h, 100 + p).min()) for p in range(bands * rows)]
            for x in range(bands):
                buckets[x][tuple(least[x * rows : (x + 1) * rows])].append(len(where))
            where.append((doc, a, b))
    meet = set()
    for bucket in buckets:
        for members in bucket.values():
            if len({where[m][0] for m in members}) > 1:
                meet.update(members)
    kept = defaultdict(list)
    for m in meet:
        kept[where[m][0]].append(where[m][1:])
    chars = found = docs = whole = 0
    for doc, spans in exact.items():
        own = sum(max(0, min(t, b) - max(s, a)) for s, t in spans for a, b in kept[doc])
        n = sum(t - s for s, t in spans)
        chars, found, docs, whole = chars + n, found + own, docs + (own > 0), whole + (own >= n)
    print(f"bands {bands}, rows {rows}: {len(where)} paragraphs, {len(meet)} collide; of {len(exact)} documents {docs} touched, {whole} whole; of {chars} characters {found} ({found / max(1, chars):.3f})")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:4]))
