"""Generated, minified and vendored files, and data kept as code.

Three kinds of evidence: the content (header and footer notes of generators
and copies, the layout of minified and templated code, literals that make up
nearly the whole file), the path and repository (folders and file names that
tools and package managers write), and Merkle hashes of directory trees.

Every file is a leaf and every folder, the root too, a subtree.  A folder's
hash is an order-free sum over the files below of a hash of content and path
from that folder on, which equals for equal trees wherever they hang; all
levels come from one pass, whatever the depth.  A subtree that recurs in
repositories of several owners is vendored if its files times the owners reach
a number (a few files may meet by chance, many do not), unless the repository
as a whole recurs (the library's own repository, or forks).  A leaf that equals a file
which its path or repository tells is as little hand-written as that one; a
leaf shared without such a witness is no evidence, as people copy their own
files, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.identity import repo_name, strip
from millrace.operators.joins import join_hot
from millrace.runtime import stage

LEAST_CHARS = 64  # letters and digits of a file that its hash can speak for

# What generators write, as whole comment lines.
_GENERATED = re.compile(
    r"""(?ix)^\W*(?:
      .*\bcode\ generated\ by\b.*|.*\bdo\s+not\s+(?:edit|modify|change|touch)\b.*
    | <?auto-?generated\b.*|(?:this|the)\ (?:file|code|module|script|class|client)\ (?:is|was|has\ been)\ (?:auto-?|automatically\ |machine[- ])?(?:generated|created|produced|written)\b.*
    | @generated\b.*|(?:automatically\ |machine[- ]|auto-?)(?:generated|created|produced|written)\b.*
    | (?:emitted|produced|created|generated|built|compiled|written)\ (?:automatically|mechanically|by\ .*(?:regenerate|re-?run|every\ (?:build|run)|tool|generator|compiler|protoc|swagger|openapi|codegen)|from\ .*(?:json|ya?ml|proto|xsd|wsdl|idl|graphql|template|schema)).*
    | .*\b(?:changes|edits)\ (?:here\ |to\ this\ file\ |made\ here\ )?(?:will|are\ going\ to)\ be\ (?:lost|overwritten|discarded).*
    | .*\bautomatisch\ (?:erzeugt|generiert|erstellt)\b.*|.*\bnicht\ (?:bearbeiten|ver(?:ä|ae)ndern|editieren)\b.*
    | .*\b(?:produit|g[ée]n[ée]r[ée]|cr[ée][ée])\ automatiquement\b.*|.*\bne\ pas\ (?:modifier|[ée]diter)\b.*
    | .*\b(?:creado|generado|producido)\ (?:por|autom[áa]ticamente)\b.*|.*\bno\ (?:editar|modificar)\b.*
    )$"""
)
# Words of a note on a copy: that it was copied, and how or from where.
_COPY_ACT = re.compile(r"(?i)\b(?:vendored|copied|taken|lifted|imported|synced|borrowed|embedded|bundled|included|mirror(?:ed)?|cop(?:y|ies)|snapshot)\b")
_COPY_ORIGIN = re.compile(r"(?i)\b(?:unchanged|verbatim|unmodified|unaltered|as[- ]is|upstream|third[- ]party|(?:release|version)\ v?\d[\w.]*)(?!\w)")


def _is_copy_note(line: str) -> bool:
    return bool(_COPY_ACT.search(line) and _COPY_ORIGIN.search(line))


# Folders and files that nobody writes by hand, in the lower-cased path.
_PATH = re.compile(
    r"""(?x)(?:^|/)(?:_?vendor|vendored|third[_-]?party|node[_-]modules|bower[_-]components|jspm[_-]packages|site[_-]packages|dist[_-]packages|\.?venv|virtualenv|\.tox|swagger[_-]client|openapi[_-]client|autogen|_?generated|__generated__|gen|codegen|gen-src|pods|carthage|\.bundle)/
    |(?:^|/)build/(?:lib|generated|out|classes)/|(?:^|/)external/[^/]+-v?\d[\w.]*/|(?:^|/)(?:dist|bundle)/[^/]+\.js$
    |_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|js)$|[._-]min\.(?:js|css)$|\.(?:bundle|chunk)\.js$|\.g\.(?:py|js|dart|cs|ts)$|[._](?:generated|autogen|gen)\.\w+$|/(?:assets|static)/(?:.*/)?[^/]+[-.][0-9a-f]{8,}\.js$|^(?:assets|static)/(?:.*/)?[^/]+[-.][0-9a-f]{8,}\.js$"""
)
_REPO = re.compile(r"(?:^|[/_-])(?:generated[_-](?:sdk|client|api|code)s?|(?:auto|code)gen(?:erated)?[_-](?:sdk|client|api)s?|vendored(?:[_-]mirror)?|vendor[_-]mirror|third[_-]party[_-]\w+)(?:$|[_-])")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;)")
_OPENING = re.compile(r"""\s*[rRuU]?(?:\"\"\".*?\"\"\"|'''.*?''')""", re.S)
_STRING = re.compile(r"""[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')""", re.S)
_NUMBERED = re.compile(r"(?:\bdef|\bfunction)\s+([A-Za-z_$]*?)_*(\d+)\s*\(")
_LITERAL = re.compile(r"0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d*)?(?:[eE][+-]?\d+)?|\b(?:None|null|True|False|true|false)\b|[\s,;:(){}\[\]+=.*/\\-]")


def content_kind(code: str) -> str:
    """"generated", "vendored", "minified", "data" or nothing, by the text alone."""
    text = code.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    # Notes stand at the file's edge: the comment block before or after all code, or the text that opens the file.
    for side in (lines, reversed(lines)):
        for line in side:
            if not line.strip():
                continue
            if not _COMMENT.match(line):
                break
            if _GENERATED.match(line):
                return "generated"
            if _is_copy_note(line):
                return "vendored"
    opening = _OPENING.match(text)
    if opening:
        for line in opening[0].split("\n"):
            if _GENERATED.match(line):
                return "generated"
            if _is_copy_note(line):
                return "vendored"
    size = len(text.strip())
    if not size:
        return ""
    longest = max(lines, key=len)
    if len(longest) >= 200:
        bare = _STRING.sub("", longest)
        marks = sum(bare.count(c) for c in ";{}")
        blanks = sum(map(str.isspace, bare))
        if len(bare) >= 150 and marks >= len(bare) / 60 and blanks <= len(bare) * 0.09 and len(longest) >= 0.4 * size:
            return "minified"
    if not re.search(r"\bdef\s+\w+\s*\(|\bfunction\b|=>|\bclass\s+\w+", text):
        kept = _STRING.sub("", text)
        if re.search(r"(?m)^DESCRIPTOR\s*=|_pool\w*\(\)", kept) and len(text) - len(kept) >= 0.2 * size:
            return "generated"  # a descriptor that a schema compiler wrote
        names = _LITERAL.sub("", re.sub(r"(?m)^\s*(?:#|//).*$", "", kept))
        if size >= 200 and len(names) <= 0.25 * size and (len(text) - len(kept) >= 0.4 * size or len(names) <= 0.12 * size):
            return "data"
    shapes = Counter(m[1] for m in _NUMBERED.finditer(text))
    if shapes and max(shapes.values()) >= 5:
        return "generated"
    return ""


def _kinds():
    schema = pa.schema([("id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("evidence", pa.list_(pa.string())), ("file_hash", pa.int64()), ("leaf", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for repo, path, code in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                kinds = [content_kind(code)] if code else []
                if path and _PATH.search(path):
                    kinds.append("path")
                if repo and _REPO.search(repo):
                    kinds.append("repository")
                told.append([k for k in kinds if k])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(told, pa.list_(pa.string())), batch.column(4), batch.column(5)], schema=schema)

    return run, "id bigint, repo string, path string, evidence array<string>, file_hash bigint, leaf boolean"


def path_name(c: Column) -> Column:
    """Lower-case path with forward slashes and without leading ``./`` or ``/``; null stays null."""
    x = F.lower(F.translate(strip(c), "\\", "/"))
    return F.regexp_replace(F.regexp_replace(x, r"/+", "/"), r"^(?:\./|/)+", "")


def folder_hashes(files: DataFrame) -> DataFrame:
    """``(repo, folder, hash, hash2, files)`` of every folder, the root as the empty one, from one ``(repo, path, file_hash)`` per path.

    Two sums keep different folders apart.  They combine before they shuffle,
    so a repository with a third of all files is a row per folder and task.
    """
    parts = F.split("path", "/")
    # Every folder above the file, with the file's path from there.
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")),
    )
    rows = files.select("repo", "file_hash", F.inline(above))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    sums = rows.groupBy("repo", "folder").agg(total("rest", "file_hash").alias("a"), total("file_hash", "rest", F.lit(1)).alias("b"), F.count(F.lit(1)).alias("files"))
    return sums.select("repo", "folder", F.xxhash64("a").alias("hash"), F.xxhash64("b", "files").alias("hash2"), "files")


def file_kinds(df: DataFrame, id_col: str, code: Column, path: Column, repo: Column, *, least_files: int = 2, least_owners: int = 2, least_copies: int = 6, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(id, kind, evidence)`` of the records that nobody in their repository wrote by hand.

    ``evidence`` lists all that tells a record (content, "path", "repository",
    "tree", "leaf"), ``kind`` the first.  A subtree counts from ``least_files``
    files in repositories of ``least_owners`` owners on, if both numbers
    multiplied reach ``least_copies``; a leaf from ``least_chars`` letters and
    digits.  A path with several contents is one file of all of them.  Contents are compared by letters and
    digits alone.  Null or empty code counts by its path and repository only.
    """
    plain = F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]+", "")
    source = df.select(
        F.col(id_col).cast("bigint").alias("id"), repo_name(repo).alias("repo"), path_name(path).alias("path"), code.alias("code"), F.xxhash64(plain).alias("file_hash"),
        F.coalesce(F.length(plain) >= least_chars, F.lit(False)).alias("leaf"),
    )
    run, kind = _kinds()
    rows = stage(source.mapInArrow(run, kind), "kind-files")
    owner = F.substring_index("repo", "/", 1)
    placed = rows.where("repo is not null and path is not null and path <> ''")
    files = placed.select("repo", "path", "file_hash").distinct().groupBy("repo", "path").agg(F.xxhash64(F.sum(F.col("file_hash").cast("decimal(20,0)"))).alias("file_hash"))
    folders = stage(folder_hashes(files).where(F.col("files") >= least_files), "kind-folders")
    shared = folders.groupBy("hash", "hash2").agg(F.countDistinct(owner).alias("owners"), F.first("files").alias("n"))
    shared = shared.where((F.col("owners") >= least_owners) & (F.col("owners") * F.col("n") >= least_copies)).select("hash", "hash2")
    hits = stage(folders.join(shared, ["hash", "hash2"]).select("repo", "folder"), "kind-shared")
    whole = hits.where("folder = ''").select("repo")
    marked = stage(hits.where("folder <> ''").join(whole, "repo", "left_anti"), "kind-trees")
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    below = placed.where("path like '%/%'").select("id", "repo", F.explode(above).alias("folder"))
    tree = join_hot(below, marked, ["repo", "folder"]).select("id", F.lit("tree").alias("more"))
    # A leaf with a witness, in enough repositories that all but one of them must have copied it.
    witness = F.array_contains("evidence", "path") | F.array_contains("evidence", "repository")
    leaves = placed.where("leaf").groupBy("file_hash").agg(F.countDistinct(owner).alias("owners"), F.bool_or(witness).alias("told"))
    leaves = stage(leaves.where(F.col("told") & (F.col("owners") > least_owners)).select("file_hash"), "kind-leaves")
    leaf = join_hot(placed.where("leaf").select("id", "file_hash"), leaves, ["file_hash"]).select("id", F.lit("leaf").alias("more"))
    more = tree.unionByName(leaf).groupBy("id").agg(F.sort_array(F.collect_set("more"), asc=False).alias("more"))
    told = rows.where(F.size("evidence") > 0).select("id", "evidence").join(more, "id", "full")
    every = F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    return told.select(F.col("id").alias(id_col), every[0].alias("kind"), every.alias("evidence"))
