"""Text units of Office packages (docx, pptx, xlsx) and packages with their units rewritten.

A streaming parser finds the units of a part and the bytes at which their text stands. Values are found and replaced by
Spark's own functions over a table of units; only what changed goes back to its package, whose other bytes stay as they
are. Packages are cells of a binary column, so none is over 2 GiB.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.detect import detect, mask, pseudonym, rewritten
from veilspark.plans.rules import RuleSet

#: What is refused: packages with more parts, larger parts or more bytes than this, or with parts outside the package.
MOST_PARTS, MOST_PART, MOST_BYTES = 100_000, 1 << 31, 8 << 30
MOST_PASSES = 8
# Which elements of which parts are units, how they are rewritten, and which elements inside them hold
# text (none given: all).
RUNS = ("t", "instrText", "delText")
PARTS = (
    (re.compile(r"^word/.*\.xml$"), {"p": ("text", RUNS)}),
    (re.compile(r"^ppt/comments/.*\.xml$"), {"cm": ("text", ("text",))}),
    (re.compile(r"^(ppt|xl|word)/charts/.*\.xml$"), {"pt": ("digits", ("v",)), "p": ("text", ("t",))}),
    (re.compile(r"^ppt/.*\.xml$"), {"p": ("text", ("t",))}),
    (re.compile(r"^xl/sharedStrings\.xml$"), {"si": ("text", ("t",))}),
    (re.compile(r"^xl/comments.*\.xml$"), {"text": ("text", ("t",)), "author": ("redacted", ())}),
    (re.compile(r"^xl/worksheets/.*\.xml$"), {"c": ("cell", ("t", "f", "v"))} | {k: ("text", ()) for k in ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")}),
    (re.compile(r"^docProps/custom\.xml$"), {"property": ("property", ())}),
    (re.compile(r"^docProps/(core|app)\.xml$"), {k: ("text", ()) for k in ("title", "subject", "description", "keywords", "lpwstr", "bstr")} | {k: ("已脱敏", ()) for k in ("creator", "lastmodifiedby", "manager", "company", "author")}),
)
FREE_TEXT = re.compile(r"^customXml/.*\.xml$|^docProps/app\.xml$|/persons/.*\.xml$|/comments.*\.xml$")
AUTHOR = ("author", "initials", "userId", "displayName", "email")
UNSAFE = re.compile(r"(?i)/embeddings/|/activex/|vbaproject\.bin$|^_xmlsignatures/")
PICTURE, THUMBNAIL = re.compile(r"(?i)^(word|xl|ppt)/media/"), re.compile(r"(?i)^docProps/thumbnail\.")
PROPERTY = (
    (re.compile("bool"), "false"),
    (re.compile("filetime|date"), "1970-01-01T00:00:00Z"),
    (re.compile("clsid"), "{00000000-0000-0000-0000-000000000000}"),
    (re.compile("i[1248]|int|ui[1248]|uint|r[48]|decimal|cy|error"), "0"),
    (re.compile("o?blob|cf"), ""),
)

TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")
UNIT = "file string, part string, location string, unit int, mode string, text string, error string"
Run = tuple[int, int, str, str]


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _property(kind: str) -> str:
    return next((value for pattern, value in PROPERTY if pattern.fullmatch(kind.lower())), "redacted")


def _attribute(tag: bytes, names: tuple[str, ...], value: str) -> bytes:
    own = "|".join(names).encode()
    return re.sub(rb"""(\s(?:[\w.-]+:)?(?:""" + own + rb""")\s*=\s*)(?:"[^"]+"|'[^']+')""", lambda m: m[1] + b'"' + value.encode() + b'"', tag)


class _Part:
    """One part while it is read: `ready` has its units (location, mode, runs), `edits` what changes whatever is found."""

    def __init__(self, name: str, raw: bytes | None = None):
        self.name, self.raw, self.ready, self.edits = name, raw, [], []
        self.rules, self.free = {}, bool(FREE_TEXT.search(name))
        for pattern, rules in PARTS:
            if pattern.match(name):
                self.rules = rules | self.rules
        self.core = name.startswith("docProps/")
        self.stack, self.open, self.run = [], None, None
        p = self.parser = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.chars
        p.StartCdataSectionHandler = lambda: self.chars("")
        p.CommentHandler = lambda _: self.close()
        p.ProcessingInstructionHandler = lambda *_: self.close()
        p.StartDoctypeDeclHandler, p.XmlDeclHandler = self.refuse, self.declared

    def refuse(self, *_) -> None:
        raise ValueError("a part declares a document type")

    def declared(self, _version, encoding, _alone) -> None:
        if encoding and encoding.lower() not in ("utf-8", "us-ascii"):
            raise ValueError("a part isn't in UTF-8")

    def chars(self, data: str) -> None:
        if self.run is None:
            self.run = (self.parser.CurrentByteIndex, [])
        self.run[1].append(data)

    def close(self) -> None:
        if self.run is None:
            return
        begin, text = self.run[0], "".join(self.run[1])
        self.run = None
        run = (begin, self.parser.CurrentByteIndex, text, self.stack[-1] if self.stack else "")
        if self.open:
            self.open[4].append(run)
        elif self.free and text.strip():
            self.ready.append((self.name, "text", [run]))

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self.close()
        local, own = _local(name), {_local(k): v for k, v in attrs.items()}
        rule = self.rules.get(local.lower() if self.core else local)
        at = self.parser.CurrentByteIndex
        if rule and not self.open:
            where = self.name + ("!" + own["r"] if own.get("r") else "")
            self.open = (len(self.stack), where, rule, own.get("t", "n"), [], at)
        if self.name == "xl/workbook.xml" and local == "sheet" and own.get("name"):
            self.ready.append((self.name, "refuse", [(at, at, own["name"], "name")]))
        self.stack.append(local)
        if self.raw is None:
            return
        if self.name.endswith(".rels"):
            if own.get("TargetMode", "").lower() == "external":
                self.tag(at, ("Target",), "about:blank")
        elif any(own.get(a, "").strip() for a in AUTHOR):
            self.tag(at, AUTHOR, "redacted")

    def tag(self, at: int, names: tuple[str, ...], value: str) -> None:
        old = TAG.match(self.raw, at)[0]
        self.edits.append((at, at + len(old), _attribute(old, names, value)))

    def end(self, _name: str) -> None:
        self.close()
        self.stack.pop()
        if not self.open or self.open[0] != len(self.stack):
            return
        (_, where, (mode, targets), kind, runs, at), self.open = self.open, None
        if mode == "cell":
            self.cell(where, kind, runs, at)
        else:
            held = [r for r in runs if not targets or r[3] in targets]
            if any(r[2].strip() for r in held):
                self.ready.append((where, mode, held))

    def cell(self, where: str, kind: str, runs: list[Run], at: int) -> None:
        formula = [r for r in runs if r[3] == "f"]
        has = any(r[2].strip() for r in formula)
        if has:
            self.ready.append((where, "refuse", formula))
        target, mode = {"inlineStr": ("t", "text"), "str": ("v", "text")}.get(kind, ("v", "digits"))
        if kind in ("s", "b", "e") or mode == "digits" and has:
            return
        held = [r for r in runs if r[3] == target]
        if any(r[2].strip() for r in held):
            # the first run of a number says where its cell's tag begins
            self.ready.append((where, mode, [(at, at, "", "c")] * (mode == "digits") + held))


def _checked(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    parts = z.infolist()
    names = [p.filename.replace("\\", "/") for p in parts]
    outside = any(n.startswith("/") or ":" in n or {"..", "."} & set(n.split("/")) for n in names)
    if outside or len(parts) > MOST_PARTS or len(set(names)) < len(names) or "[Content_Types].xml" not in names:
        raise ValueError("not a safe package")
    if sum(p.file_size for p in parts) > MOST_BYTES or any(p.file_size > MOST_PART for p in parts):
        raise ValueError("a package or part is too large")
    return parts


def _units(content: bytes) -> Iterator[tuple[str, str, int, str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in _checked(z):
            part = _Part(info.filename)
            if not part.rules and not part.free and part.name != "xl/workbook.xml":
                continue
            n = 0
            with z.open(info) as f:
                while True:
                    data = f.read(1 << 20)
                    part.parser.Parse(data, not data)
                    for where, mode, runs in part.ready:
                        yield part.name, where, n, mode if mode in ("text", "digits", "refuse") else "fixed", "".join(r[2] for r in runs)
                        n += 1
                    part.ready.clear()
                    if not data:
                        break


def _spread(runs: list[Run], text: str) -> Iterator[tuple[int, int, bytes]]:
    """The runs with `text` dealt over them by their old lengths; the last one takes what is left."""
    at = 0
    for i, (begin, end, old, _) in enumerate(runs):
        upto = len(text) if i == len(runs) - 1 else at + len(old)
        if begin < end:
            yield begin, end, escape(text[at:upto]).encode()
        at = upto


def _number_as_text(raw: bytes, at: int) -> tuple[int, int, bytes]:
    old = TAG.match(raw, at)[0]
    new = re.sub(rb"""\st\s*=\s*(?:"[^"]*"|'[^']*')""", b"", old)
    cut = len(new) - (2 if new.endswith(b"/>") else 1)
    return at, at + len(old), new[:cut] + b' t="str"' + new[cut:]


def _part_bytes(name: str, raw: bytes, changes: dict[tuple[str, int], str]) -> bytes:
    part = _Part(name, raw)
    part.parser.Parse(raw, True)
    edits = {e[0]: e for e in part.edits}
    for n, (_, mode, runs) in enumerate(part.ready):
        if mode == "property":
            edits |= {r[0]: (r[0], r[1], escape(_property(r[3])).encode()) for r in runs if r[2].strip()}
        elif mode not in ("text", "digits", "refuse"):
            edits |= {r[0]: (r[0], r[1], (mode if i == 0 else "").encode()) for i, r in enumerate(runs)}
        elif (name, n) in changes:
            edits |= {e[0]: e for e in _spread(runs, changes[name, n])}
            if mode == "digits" and runs[0][3] == "c":
                edits[runs[0][0]] = _number_as_text(raw, runs[0][0])
    out, at = [], 0
    for begin, end, new in sorted(edits.values()):
        out += [raw[at:begin], new]
        at = end
    return b"".join(out) + raw[at:]


def _package(content: bytes, changes: dict[tuple[str, int], str], keep_pictures: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in _checked(z):
            name, raw = info.filename, z.read(info)
            if UNSAFE.search("/" + name) or UNSAFE.search(name):
                raise ValueError("holds an embedded object, active content or a signature")
            if PICTURE.match(name) and not info.is_dir() and not keep_pictures:
                raise ValueError("holds a picture, whose text can't be read here")
            if THUMBNAIL.match(name):
                raw = b""
            elif name.endswith((".xml", ".rels")) and name != "[Content_Types].xml":
                raw = _part_bytes(name, raw, changes)
            copy = zipfile.ZipInfo(name, info.date_time)
            copy.compress_type = zipfile.ZIP_DEFLATED
            new.writestr(copy, raw)
    return out.getvalue()


FAULTS = (ValueError, zipfile.BadZipFile, expat.ExpatError, NotImplementedError, RuntimeError)


#: Rows go to Spark in frames of so many, or of so many characters or bytes: one frame a package costs more than its parsing.
ROWS, SIZE = 10_000, 16 << 20


def _framed(rows: Iterator[tuple], names: list[str], big: int) -> Iterator[pd.DataFrame]:
    """The rows in frames; column `big` is what makes a row large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[big] or "")
        if len(held) == ROWS or size >= SIZE:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    for unit in _units(bytes(content or b"")):
                        yield (path, *unit, None)
                except FAULTS as e:
                    yield (path, None, None, None, None, None, str(e)[:200])

    return _framed(rows(), [c.split()[0] for c in UNIT.split(", ")], 5)


def units(files: DataFrame) -> DataFrame:
    """A row for each unit of text (paragraph, cell, shared string, comment, chart point, header, property) of the packages
    (path, content): file, part, location, unit, mode (how it is rewritten), text; a file that isn't a safe package also
    gives a row with an error."""
    return files.select("path", "content").mapInPandas(_read, UNIT)


def packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """The units of the packages below `path`."""
    return units(packages(spark, path))


def _passes(found: DataFrame, rules: RuleSet | None, key: bytes | None) -> list[DataFrame]:
    """What each pass of detection changes (file, part, unit, mode, text); the first one also has the units to refuse that
    hold a value."""
    replace = (lambda v, r: mask(v)) if key is None else pseudonym(key)
    columns = ("file", "part", "unit", "mode")
    todo, done = found.where("mode IN ('text', 'digits', 'refuse')").select(*columns, "text"), []
    for _ in range(MOST_PASSES):
        seen = detect(todo, rules)
        digits = rewritten(F.col("text"), F.col("found"), lambda v, r: F.regexp_replace(v, r"\p{Nd}", "0"))
        new = F.when(F.col("mode") == "digits", digits).when(F.col("mode") == "text", rewritten(F.col("text"), F.col("found"), replace))
        # a wrapped column, so the optimizer doesn't put detection into the filter a second time
        seen = seen.select(*columns, F.explode(F.array(F.struct(F.col("text").alias("old"), new.alias("new"), (F.size("found") > 0).alias("held")))).alias("x"))
        changed = seen.where("CASE WHEN mode = 'refuse' THEN x.held ELSE x.new <> x.old END").select(*columns, F.col("x.new").alias("text")).checkpoint()
        done.append(changed)
        todo = changed.where("mode <> 'refuse'")
        if todo.isEmpty():
            break
    return done


def _last(done: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, (x.where("mode <> 'refuse'").withColumn("at", F.lit(i)) for i, x in enumerate(done)))
    return every.groupBy("file", "part", "unit").agg(F.max_by("text", "at").alias("text"))


def redacted_units(found: DataFrame, rules: RuleSet | None = None, key: bytes | None = None) -> DataFrame:
    """The units (file, part, unit, text) whose text changes, as it is after at most 8 passes of detection over those that
    the pass before changed; numbers get zeros for digits and stay numbers to read."""
    return _last(_passes(found.where("mode <> 'refuse'"), rules, key))


def redacted_packages(files: DataFrame, rules: RuleSet | None = None, key: bytes | None = None, keep_pictures: bool = False) -> DataFrame:
    """The packages (path, content) rewritten: path, content, changed (units), error; content is null where there is an error.

    Found values are masked (or replaced by keyed pseudonyms), authors and custom properties are overwritten, outer links
    point nowhere, thumbnails are emptied. Refused are values in formulas and sheet names, embedded objects, macros,
    signatures, and pictures unless they are kept. Texts of units are found in one job; the packages are joined with their
    changes once. Needs spark.checkpoint.dir."""
    done = _passes(units(files), rules, key)
    refused = done[0].where("mode = 'refuse'").select("file", F.lit(None).alias("change"))
    both = _last(done).select("file", F.struct("part", "unit", "text").alias("change")).unionByName(refused)
    # collect_list leaves the nulls out, so a file with more rows than changes holds a unit to refuse
    changes = both.groupBy("file").agg(F.collect_list("change").alias("changes"), (F.count(F.lit(1)) > F.count("change")).alias("held"))
    both = files.select("path", "content").join(changes, F.col("path") == changes["file"], "left").select("path", "content", "changes", F.coalesce("held", F.lit(False)).alias("held"))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for part in parts:
            for path, content, changed, refused in zip(part["path"], part["content"], part["changes"], part["held"]):
                new = {(c["part"], c["unit"]): c["text"] for c in (changed if changed is not None else ())}
                out, error = None, None
                try:
                    if refused:
                        raise ValueError("a formula or a sheet's name holds a value")
                    out = _package(bytes(content or b""), new, keep_pictures)
                except FAULTS as e:
                    error = str(e)[:200]
                yield path, out, len(new), error

    rewrite = lambda parts: _framed(rows(parts), ["path", "content", "changed", "error"], 1)
    return both.mapInPandas(rewrite, "path string, content binary, changed int, error string")

