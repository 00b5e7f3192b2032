"""Pairs of code and description: functions and methods with their own documentation.

Strings and comments are found first and blanked, so brackets, quotes and
definitions inside them count for nothing.  A recursive pattern then takes
comment block, signature with balanced brackets and body in one match: the
indented block of Python, the balanced braces of JavaScript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 4

_PY_LEX = re.compile(
    r"""\#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"|\Z)|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z))""",
    re.S,
)
_JS_LEX = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\.)*+(?:`|\Z)""", re.S)
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+", re.M)
_JS_DEF = re.compile(r"(?:\bfunction\b[ \t]*\*?[ \t]*(?P<f>[A-Za-z_$][\w$]*)|\b(?:const|let|var)[ \t]+(?P<c>[A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?=\(|function\b|[A-Za-z_$][\w$]*[ \t]*=>))")
# In the blanked text a comment is a run of \x01 and a string a run of \x02, line ends within them included.
_PY = regex.compile(
    r"""(?P<lead>(?:^[ \t]*\x01++[ \t]*\n)*+)(?P<deco>(?:^[ \t]*@[^\n(]*(?P<dp>\((?:[^()]++|(?&dp))*+\))?[^\n]*\n)*+)
    ^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?P<sig>\((?:[^()]++|(?&sig))*+\))[^:\n]*:
    (?P<body>[^\n]*+(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++[^\n]++))*+)""",
    regex.V1 | regex.M | regex.X,
)
_PY_LOOSE = regex.compile(
    r"""(?P<lead>(?:^[ \t]*\x01++[ \t]*\n)*+)(?P<deco>(?:^[ \t]*@[^\n]*\n)*+)
    ^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)(?P<sig>[^\n:]*):?
    (?P<body>[^\n]*+(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++[^\n]++))*+)""",
    regex.V1 | regex.M | regex.X,
)
_JS = regex.compile(
    r"""(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:const|let|var)[ \t]+(?P<name>[A-Za-z_$][\w$]*)[ \t]*=[ \t]*)?(?:async\b[ \t]*)?
    (?:function\b[ \t]*\*?[ \t]*(?P<own>[A-Za-z_$][\w$]*)?[ \t]*)?(?P<sig>\((?:[^()]++|(?&sig))*+\)|[A-Za-z_$][\w$]*)\s*(?:=>)?\s*
    (?P<body>(?P<brace>\{(?:[^{}]++|(?&brace))*+\})|[^\n]*)""",
    regex.V1 | regex.X,
)
_STATEMENT_ENDS = re.compile(r"[ \t]*(?:\Z|[\n;\x01])")
_ARROW = re.compile(r"\s*=>")
# Tags and notes that say nothing by themselves.
_TAGS = re.compile(
    r"(?i)[:@\\](?:param|parameter|arg|argument|key|keyword|type|raises?|throws|exception|var|ivar|property|prop|typedef|template|field)\b[ \t]*(?:\{[^}]*\})?[ \t]*[\w.*\[\]\-]*:?"
    r"|[:@\\](?:returns?|rtype|yields?|see|todo|deprecated|author|since|version|example|async|function|method|name|brief|description|desc|note|private|public|static|memberof|class)\b:?(?:[ \t]*\{[^}]*\})?"
    r"|^\s*(?:args|arguments|parameters|params|returns?|raises|yields|examples?|notes?)\s*:?\s*-*$",
    re.M,
)
_NOTES = re.compile(
    r"(?i)\b(?:to-?do|fix-?me|xxx|tbd|tba|hack|wip)\b|\b(?:add|write|insert|put|fill in|complete|update|missing|needs?)\s+(?:an?\s+|the\s+|some\s+|proper\s+|your\s+|better\s+|more\s+)*(?:doc(?:s|strings?|umentation)?|descriptions?|comments?|summary|text)\b(?:\s+(?:here|later|soon|please))?"
    r"|\b(?:your\s+)?(?:doc(?:s|strings?|umentation)?|descriptions?|comments?|summary|text)\s+(?:goes\s+|comes\s+|to\s+come\s*)?(?:here|later|missing|needed|pending)\b|\bnot\s+(?:yet\s+)?(?:documented|implemented|described|written)(?:\s+yet)?\b|\bno\s+(?:description|documentation|docs?|docstring|comment)s?(?:\s+(?:yet|available|provided|given|here))*\b"
    r"|\blorem ipsum\b|\bplaceholder\b|\bdescribe\s+(?:me|this|the\s+function|this\s+function|later|here)\b|\bauto-?generated\s+(?:docstring|comment|stub)\b|\bsee\s+(?:above|below)\b|\bundocumented\b|\bdocstring\b",
)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+(?:\.\d+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _blank(text: str, lex: re.Pattern, comment: tuple) -> tuple[str, dict[int, int]]:
    """The text with strings and comments blanked at their places, and the end of each string by its start."""
    out, last, strings = [], 0, {}
    for m in lex.finditer(text):
        a, b = m.span()
        out.append(text[last:a])
        if text.startswith(comment, a):
            out.append("\x01" * (b - a))
        else:
            strings[a] = b
            out.append("\x02" * (b - a))
        last = b
    out.append(text[last:])
    return "".join(out), strings


def says_something(doc: str, name: str) -> bool:
    """Whether at least four words are left without tags, notes and the words of the function's own name."""
    own = {w.lower() for w in _PARTS.findall(name)} | {name.lower()}
    left = _NOTES.sub(" ", _TAGS.sub(" ", doc))
    n = 0
    for w in re.findall(r"[^\W]+(?:'[^\W\d_]+)?", left):
        parts = {p.lower() for p in _PARTS.findall(w)} or {w.lower()}
        if w.lower() not in own and not parts <= own and not set(w) <= {"_"}:
            n += 1
            if n >= LEAST_WORDS:
                return True
    return False


def _literal(s: str) -> str:
    s = re.sub(r"^[rRbBuUfF]{0,2}", "", s)
    q = s[:3] if s[:3] in ('"""', "'''") else s[:1]
    return s[len(q) : len(s) - len(q)] if s.endswith(q) and len(s) >= 2 * len(q) else s[len(q) :]


def _block_before(masked: str, at: int) -> int:
    """Start of the comment lines and decorators that end right before the line starting at ``at``."""
    while at:
        begin = masked.rfind("\n", 0, at - 1) + 1
        line = masked[begin : at - 1].strip()
        if not (line and (set(line) == {"\x01"} or line[0] == "@")):
            break
        at = begin
    return at


def _python(text: str, masked: str, strings: dict[int, int]) -> Iterator[tuple[str, str, int, int, int]]:
    """(name, documentation, start, stop, place of the def) of each function."""
    for d in _PY_DEF.finditer(masked):
        begin = _block_before(masked, d.start())
        m = _PY.match(masked, begin) or _PY_LOOSE.match(masked, begin)
        while m is None or m.end() <= d.start():
            begin = masked.find("\n", begin) + 1
            if not 0 < begin <= d.start():
                break
            m = _PY.match(masked, begin) or _PY_LOOSE.match(masked, begin)
        if m is None or m.end() <= d.start():
            continue
        first = re.compile(r"(?:[ \t\n]|\x01)*").match(masked, m.start("body")).end()
        stop = strings.get(first)
        doc = None
        if stop is not None and first < m.end("body") and not re.match(r"[fFbB]", text[first]) and _STATEMENT_ENDS.match(masked, stop):
            line = masked.rfind("\n", 0, first) + 1
            deeper = line > m.start("body") and len(masked[line:first].expandtabs()) > len(m["indent"].expandtabs())
            if line <= m.start("body") or deeper:
                doc = _literal(text[first:stop])
        if doc is None and m["lead"]:
            a, b = m.span("lead")
            doc = "\n".join(re.sub(r"^[ \t]*#+[!:]?", "", x) for x in text[a:b].split("\n"))
        yield m["name"], doc or "", m.start(), m.end(), d.start()


def _js_comment_before(text: str, masked: str, at: int) -> str:
    """The comment lines or the comment block that end right above the line of ``at``."""
    line = masked.rfind("\n", 0, at) + 1
    if masked[line:at].replace("export", "").replace("default", "").replace("async", "").strip(" \t("):
        return ""
    lines, end = [], line
    while end:
        begin = masked.rfind("\n", 0, end - 1) + 1
        row = masked[begin : end - 1].strip()
        if not row or set(row) != {"\x01"}:
            break
        raw = text[begin : end - 1].strip()
        block = raw.startswith("/*")
        if block and lines:
            break
        if block and not raw.startswith("/**"):
            # A plain block comment counts as comment lines.
            raw = raw[1:]
        lines.append(raw)
        end = begin
        if block:
            break
    return "\n".join(re.sub(r"^\s*(?://+|/\*+|\*+(?!/))|\*+/\s*$", "", x, flags=re.M) for x in reversed(lines))


def _javascript(text: str, masked: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, documentation, start, stop) of each function."""
    # A block comment is one run here, so its lines count as one line.
    for d in _JS_DEF.finditer(masked):
        if d["f"]:
            before = masked[masked.rfind("\n", 0, d.start()) + 1 : d.start()]
            if re.search(r"=\s*(?:async\s*)?$", before):
                continue  # the name after const stands for it
        m = _JS.match(masked, d.start())
        if m is None or not (m["name"] or m["own"]):
            continue
        if d["c"] and not m["own"] and not _ARROW.match(masked, m.end("sig")) and "function" not in masked[d.start() : m.start("sig")]:
            continue
        yield d["f"] or d["c"], _js_comment_before(text, masked, d.start()), d.start(), m.end()


def functions(code: str) -> Iterator[tuple[str, str, str]]:
    """(name, documentation, code) of each function or method; the documentation may be empty.

    A text is read as Python where it has definitions of that form, else as
    JavaScript.  Where code outside Python's definitions, strings and comments
    defines JavaScript functions, those count, and definitions inside a
    JavaScript string or comment do not.
    """
    text = code.replace("\r\n", "\n").replace("\r", "\n")
    own, scripts = [], []
    script = "function" in text or "=>" in text
    masked = ""
    if "def" in text:
        masked, strings = _blank(text, _PY_LEX, ("#",))
        own = list(_python(text, masked, strings))
    if script and (not own or _JS_DEF.search(masked)):
        hidden, _ = _blank(text, _JS_LEX, ("//", "/*"))
        spans = [(a, b) for _, _, a, b, _ in own]
        scripts = [f for f in _javascript(text, hidden) if not own or masked[f[2]] not in "\x01\x02" and not any(a <= f[2] < b for a, b in spans)]
        if own and scripts:
            own = [f for f in own if not set(hidden[f[4] : f[4] + 1]) & {"\x01", "\x02"}]
    for name, doc, a, b, *_ in own + scripts:
        yield name, doc, text[a:b]


def documented(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """``(id, func_name, documentation, code)``: a row per function whose documentation says something.

    Null and empty code has no functions; a name defined twice in a record with documentation gives a row each time.
    """
    schema = pa.schema([("id", pa.int64()), ("func_name", pa.string()), ("documentation", pa.string()), ("code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, doc, own in functions(code or ""):
                    if doc and says_something(doc, name):
                        rows.append((i, name, doc.strip(), own))
                        size += len(own)
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).alias("code")).where("code is not null")
    return out.mapInArrow(run, "id bigint, func_name string, documentation string, code string").withColumnRenamed("id", id_col)
