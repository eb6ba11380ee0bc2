"""Office packages by byte places: what stands where in their XML parts, and
parts with some byte ranges replaced.  Everything outside the ranges stays as it
is, so formatting, comments and declarations of untouched markup are byte-equal.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.parsers import expat
from xml.sax.saxutils import escape

from parallex.sources.segments import opened

# Name spaces and parts of the two formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WORD_2010 = "http://schemas.microsoft.com/office/word/2010/wordml"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
CHART = "http://schemas.openxmlformats.org/drawingml/2006/chart"
EXCEL_FORMULA = "http://schemas.microsoft.com/office/excel/2006/main"
WORD_PART = re.compile(r"word/(?:document|header\d+|footer\d+|footnotes|endnotes|comments)\.xml")
SHEET_PART = re.compile(r"xl/worksheets/[^/]+\.xml")

_TAG = re.compile(rb"<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
_SPACE = re.compile(rb"\sxml:space\s*=\s*(?:\"[^\"]*\"|'[^']*')")


class Refused(ValueError):
    """A package or an edit that write-back doesn't take; the message is a code."""


def package(data: bytes) -> zipfile.ZipFile:
    """The container; signed and macro packages and repeated entries are refused."""
    try:
        box = opened(data)
    except (zipfile.BadZipFile, ValueError) as e:
        raise Refused("UNREADABLE_PACKAGE") from e
    names = box.namelist()
    if len(names) != len(set(names)):
        raise Refused("REPEATED_ENTRY")
    if any(n.startswith("_xmlsignatures/") or n.lower().endswith("vbaproject.bin") for n in names):
        raise Refused("SIGNED_OR_MACRO_PACKAGE")
    return box


class Scan:
    """Walks a UTF-8 part; subclasses see elements with their byte places.  With a
    ``home`` the root's name space counts as that one, for strict documents name
    their elements in another."""

    home: str | None = None
    #: Elements whose places are asked for (None: all); others have zeros.
    placed: set[str] | None = None

    def __init__(self, raw: bytes):
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\x00" in raw:
            raise Refused("NOT_UTF8")
        self.raw, self.stack = raw, []
        self._parser = expat.ParserCreate(namespace_separator="|")
        self._parser.buffer_text = True
        self._parser.StartElementHandler = self._open
        self._parser.EndElementHandler = self._close
        self._parser.CharacterDataHandler = self.text
        self._parser.StartDoctypeDeclHandler = self._doctype
        try:
            raw.decode("utf-8")
            self._parser.Parse(raw, True)
        except (expat.ExpatError, UnicodeDecodeError) as e:
            raise Refused("INVALID_XML") from e

    def _doctype(self, *_) -> None:
        raise Refused("DOCUMENT_TYPE")

    def _open(self, name: str, attributes: dict) -> None:
        begin = self._parser.CurrentByteIndex
        if not self.stack and self.home:
            self._own = name.rpartition("|")[0] + "|"
        if self.home and self._own != self.home + "|":
            name, *keys = (self.home + "|" + x[len(self._own) :] if x.startswith(self._own) else x for x in (name, *attributes))
            attributes = dict(zip(keys, attributes.values()))
        # [name, attributes, begin, where the content begins, where it ends, end]
        item = [name, attributes, begin, 0, 0, 0]
        if self.placed is None or name in self.placed:
            item[3] = item[4] = item[5] = _TAG.match(self.raw, begin).end()
        self.begin(item)
        self.stack.append(item)

    def _close(self, name: str) -> None:
        item = self.stack.pop()
        if item[3] and self.raw[item[3] - 2 : item[3]] != b"/>":
            item[4] = self._parser.CurrentByteIndex
            item[5] = self.raw.index(b">", item[4]) + 1
        self.end(item)

    def begin(self, item: list) -> None: ...

    def end(self, item: list) -> None: ...

    def text(self, letters: str) -> None: ...


# --- word processing ------------------------------------------------------------

# Elements that make a paragraph's text more than text.
_FIELD = {f"{WORD}|{x}" for x in ("fldChar", "instrText")}
_REVISION = {f"{WORD}|{x}" for x in ("ins", "del")}
_INLINE = {f"{WORD}|{x}" for x in ("tab", "br", "cr", "fldSimple", "sym")}
BLOCKERS = ["FIELD_CODE", "TRACKED_CHANGE", "NESTED_PARAGRAPH", "STRUCTURAL_INLINE_CONTENT"]
#: Elements around a paragraph.
_AROUND = {f"{WORD}|ins": "REVISION", f"{WORD}|del": "REVISION", f"{WORD}|moveFrom": "REVISION", f"{WORD}|moveTo": "REVISION", f"{WORD}|sdt": "CONTENT_CONTROL", f"{WORD}|txbxContent": "TEXT_BOX"}


class WordPart(Scan):
    """Paragraphs in document order, nested ones too: their text nodes with byte
    places, what blocks writing them, and what they stand in: an open field (it
    may have begun paragraphs ago), a revision, a content control, a text box."""

    home = WORD
    placed = {f"{WORD}|t"}

    def __init__(self, raw: bytes):
        self.paragraphs: list[dict] = []
        self._open_paragraphs: list[dict] = []
        self._node: dict | None = None
        self._nodes = self._fields = 0
        self._around: list[str] = []
        super().__init__(raw)
        for p in self.paragraphs:
            p["text"] = "".join(n["text"] for n in p["nodes"])
            p["blockers"] = [b for b in BLOCKERS if b in p["blockers"]]

    def begin(self, item):
        name, attributes = item[0], item[1]
        if name == f"{WORD}|p":
            for p in self._open_paragraphs:
                p["blockers"].add("NESTED_PARAGRAPH")
            inside = {*self._around, *(["FIELD"] if self._fields > 0 else [])}
            self.paragraphs.append({"place": len(self.paragraphs), "para_id": attributes.get(f"{WORD_2010}|paraId"), "nodes": [], "blockers": set(), "inside": sorted(inside)})
            self._open_paragraphs.append(self.paragraphs[-1])
        elif name == f"{WORD}|t":
            self._node = {"node": self._nodes, "begin": item[2], "text": ""}
            self._nodes += 1
            for p in self._open_paragraphs:
                p["nodes"].append(self._node)
        else:
            for found, blocker in ((_FIELD, "FIELD_CODE"), (_REVISION, "TRACKED_CHANGE"), (_INLINE, "STRUCTURAL_INLINE_CONTENT")):
                if name in found:
                    for p in self._open_paragraphs:
                        p["blockers"].add(blocker)
            if name == f"{WORD}|fldChar":
                self._fields = max(0, self._fields + {"begin": 1, "end": -1}.get(attributes.get(f"{WORD}|fldCharType"), 0))
        if name in _AROUND:
            self._around.append(_AROUND[name])

    def end(self, item):
        if item[0] == f"{WORD}|p":
            self._open_paragraphs.pop()
        elif item[0] == f"{WORD}|t" and self._node is not None:
            self._node["end"] = item[5]
            self._node = None
        if item[0] in _AROUND:
            self._around.pop()

    def text(self, letters):
        if self._node is not None and self.stack[-1][0] == f"{WORD}|t":
            self._node["text"] += letters


def word_paragraphs(data: bytes) -> list[dict]:
    """Paragraphs of all parts that hold text, with ``part``."""
    box = package(data)
    return [{"part": part, **p} for part in sorted(filter(WORD_PART.fullmatch, box.namelist())) for p in WordPart(box.read(part)).paragraphs]


def dealt_edits(texts: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """The nodes' texts after ``edits`` (from, to, replacement) of their joined text,
    in order and apart.  What is replaced goes to the node where it began, an
    insertion to the node before it; so untouched runs keep their text."""
    ends, total = [], 0
    for t in texts:
        total += len(t)
        ends.append(total)
    out: list[list[str]] = [[] for _ in texts]

    def keep(begin: int, end: int) -> None:
        first = 0
        for k, last in enumerate(ends):
            if begin < last and end > first:
                out[k].append(texts[k][max(begin, first) - first : min(end, last) - first])
            first = last

    at = 0
    for begin, end, new in edits:
        keep(at, begin)
        home = next(k for k, last in enumerate(ends) if last >= begin)
        if begin < end and ends[home] == begin and home + 1 < len(texts):
            home += 1
        out[home].append(new)
        at = end
    keep(at, total)
    return ["".join(x) for x in out]


def text_element(element: bytes, text: str) -> bytes:
    """A text element with another text; blanks at its ends are preserved."""
    if any(ord(c) < 32 and c not in "\t\n\r" for c in text):
        raise Refused("CONTROL_CHARACTER")
    head = _TAG.match(element)[0]
    tail = element[element.rindex(b"<") :]
    if head.endswith(b"/>"):
        name = re.match(rb"<([^\s/>]+)", head)[1]
        head, tail = head[:-2].rstrip() + b">", b"</" + name + b">"
    if text[:1] == " " or text[-1:] == " ":
        head = _SPACE.sub(b"", head)[:-1] + b' xml:space="preserve">'
    return head + escape(text).replace("\r", "&#13;").encode() + tail


# --- spreadsheets -----------------------------------------------------------------


class SheetPart(Scan):
    """Cells of a worksheet with the byte places of their parts."""

    home = SHEET

    def __init__(self, raw: bytes):
        self.cells: list[dict] = []
        self._cell: dict | None = None
        self._letters: list[str] = []
        super().__init__(raw)

    def begin(self, item):
        name = item[0]
        if name == f"{SHEET}|c":
            self._cell = {"cell": item[1].get("r"), "kind": item[1].get("t"), "formula": False, "value": "", "inline": "", "drop": [], "before": None}
        elif self._cell is not None:
            if name == f"{SHEET}|f":
                self._cell["formula"] = True
            elif name == f"{SHEET}|extLst" and self._cell["before"] is None:
                self._cell["before"] = item[2]
        self._letters = []

    def end(self, item):
        name, cell = item[0], self._cell
        if cell is None:
            return
        if name == f"{SHEET}|v":
            cell["value"] = "".join(self._letters)
            cell["drop"].append((item[2], item[5]))
        elif name == f"{SHEET}|is":
            cell["drop"].append((item[2], item[5]))
        elif name == f"{SHEET}|t" and any(x[0] == f"{SHEET}|is" for x in self.stack):
            cell["inline"] += "".join(self._letters)
        elif name == f"{SHEET}|c":
            cell |= {"begin": item[2], "inner": item[3], "close": item[4], "end": item[5]}
            if cell["cell"]:
                self.cells.append(cell)
            self._cell = None
        self._letters = []

    def text(self, letters):
        self._letters.append(letters)


def shared_strings(box: zipfile.ZipFile) -> list[str]:
    """The workbook's strings; the texts of one, ruby too, are joined."""
    if "xl/sharedStrings.xml" not in box.namelist():
        return []
    out: list[str] = []

    class Strings(Scan):
        home, placed = SHEET, set()

        def begin(self, item):
            if item[0] == f"{SHEET}|si":
                out.append("")

        def text(self, letters):
            if self.stack and self.stack[-1][0] == f"{SHEET}|t" and out:
                out[-1] += letters

    Strings(box.read("xl/sharedStrings.xml"))
    return out


def sheet_cells(data: bytes) -> list[dict]:
    """Cells of all worksheets: ``part``, ``cell``, ``text`` or ``refused``, the
    element's bytes and places in it.  Sheet names are cells ``sheet:<id>`` of the
    workbook part, whose element is the name's value."""
    box = package(data)
    strings = shared_strings(box)
    out = []
    for part in sorted(filter(SHEET_PART.fullmatch, box.namelist())):
        raw = box.read(part)
        for c in SheetPart(raw).cells:
            text, refused = c["inline"] if c["kind"] == "inlineStr" else c["value"], None
            if c["formula"]:
                refused = "FORMULA"
            elif c["kind"] == "s":
                known = c["value"].isdecimal() and int(c["value"]) < len(strings)
                text, refused = (strings[int(c["value"])], None) if known else ("", "BAD_SHARED_STRING")
            elif c["kind"] == "b":
                text = "TRUE" if c["value"] == "1" else "FALSE"
            at = c["begin"]
            places = [c["inner"] - at, c["close"] - at, -1 if c["before"] is None else c["before"] - at, *(x - at for span in c["drop"] for x in span)]
            out.append({"part": part, "cell": c["cell"], "text": text, "refused": refused, "begin": at, "end": c["end"], "element": raw[at : c["end"]], "places": places})
    for s in sheet_names(box):
        out.append({"part": "xl/workbook.xml", "cell": f"sheet:{s['id']}", "text": s["name"], "refused": None, "begin": s["begin"], "end": s["end"], "element": b"", "places": []})
    return out


def sheet_names(box: zipfile.ZipFile) -> list[dict]:
    """Sheets with the byte places of their names' values."""
    out: list[dict] = []

    class Workbook(Scan):
        home = SHEET

        def begin(self, item):
            if item[0] == f"{SHEET}|sheet" and self.stack and self.stack[-1][0] == f"{SHEET}|sheets":
                value = re.compile(rb"\sname\s*=\s*(?:\"([^\"]*)\"|'([^']*)')").search(self.raw, item[2], item[3])
                if value:
                    begin, end = value.span(1 if value[1] is not None else 2)
                    out.append({"id": item[1].get("sheetId", ""), "name": item[1].get("name", ""), "begin": begin, "end": end})

    if "xl/workbook.xml" in box.namelist():
        Workbook(box.read("xl/workbook.xml"))
    return out


# Elements that name sheets, and how they are told.
_REFERENCES = {
    f"{SHEET}|f": "FORMULA", f"{SHEET}|formula": "RULE", f"{SHEET}|formula1": "RULE", f"{SHEET}|formula2": "RULE", f"{EXCEL_FORMULA}|f": "RULE",
    f"{SHEET}|calculatedColumnFormula": "FORMULA", f"{SHEET}|totalsRowFormula": "FORMULA", f"{SHEET}|definedName": "DEFINED_NAME", f"{CHART}|f": "CHART",
}
_REFERENCE_ATTRIBUTES = {(f"{SHEET}|worksheetSource", "sheet"): "PIVOT", (f"{SHEET}|hyperlink", "location"): "LINK"}


def sheet_references(data: bytes) -> list[dict]:
    """Everything in the package's parts that may name a sheet: formulas, rules,
    defined names, chart ranges, pivot sources, links; with byte places of texts."""
    box = package(data)
    out: list[dict] = []

    class References(Scan):
        def begin(self, item):
            self.letters = []
            for (name, attribute), kind in _REFERENCE_ATTRIBUTES.items():
                if item[0] == name and item[1].get(attribute):
                    out.append({"part": part, "kind": kind, "begin": item[2], "end": item[3], "text": item[1][attribute]})

        def text(self, letters):
            self.letters.append(letters)

        def end(self, item):
            if item[0] in _REFERENCES:
                out.append({"part": part, "kind": _REFERENCES[item[0]], "begin": item[3], "end": item[4], "text": "".join(self.letters)})

    for part in sorted(box.namelist()):
        if part.startswith("xl/") and part.endswith(".xml") and part != "xl/sharedStrings.xml":
            References(box.read(part))
    return out


def cell_element(element: bytes, places: list[int], text: str) -> bytes:
    """A cell with an inline text in place of its value; style and extensions stay."""
    if any(ord(c) < 32 and c not in "\t\n\r" for c in text):
        raise Refused("CONTROL_CHARACTER")
    inner, close, before, *drop = places
    head = re.sub(rb"\st\s*=\s*(?:\"[^\"]*\"|'[^']*')", b"", element[:inner])
    name = re.match(rb"<([^\s/>]+)", head)[1]
    prefix = name[: name.rindex(b":") + 1] if b":" in name else b""
    head = (head[:-2].rstrip() if head.endswith(b"/>") else head[:-1]) + b' t="inlineStr">'
    space = b' xml:space="preserve"' if text[:1].isspace() or text[-1:].isspace() else b""
    inline = b"<%bis><%bt%b>%b</%bt></%bis>" % (prefix, prefix, space, escape(text).replace("\r", "&#13;").encode(), prefix, prefix)
    kept, at, end = b"", inner, before if before >= 0 else close
    for a, b in [*zip(drop[::2], drop[1::2]), (end, end)]:
        if a <= end:
            kept, at = kept + element[at:a], b
    return head + kept + inline + element[end:close] + b"</" + name + b">"


def quoted_sheet(name: str) -> str:
    return "'" + name.replace("'", "''") + "'!"


def renamed_reference(text: str, old: str, new: str) -> str | None:
    """A defined name's body for a renamed sheet; None where it begins otherwise."""
    for prefix in (quoted_sheet(old), old + "!"):
        if text.startswith(prefix):
            return quoted_sheet(new) + text[len(prefix) :]
    return None


# --- whole packages ---------------------------------------------------------------


def patched(data: bytes, patches: list[tuple[str, int, int, bytes]]) -> bytes:
    """The package with byte ranges of its parts replaced (``part``, from, to, new);
    other parts, entry order and comment stay."""
    box, by = package(data), {}
    for part, *patch in patches:
        by.setdefault(part, []).append(patch)
    if by.keys() - set(box.namelist()):
        raise Refused("NO_SUCH_PART")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        new.comment = box.comment
        for info in box.infolist():
            body = box.read(info)
            after = len(body) + 1
            for begin, end, text in sorted(by.get(info.filename, ()), reverse=True):
                if end > after:
                    raise Refused("OVERLAPPING_EDITS")
                body, after = body[:begin] + text + body[end:], begin
            new.writestr(info, body)
    return out.getvalue()


def skeleton(raw: bytes, part: str) -> bytes:
    """A part without what write-back may change: a word part's texts and their
    attribute for blanks; other parts whole."""
    if not WORD_PART.fullmatch(part):
        return raw
    spans: list[tuple[int, int]] = []

    class Nodes(Scan):
        home, placed = WORD, {f"{WORD}|t"}

        def end(self, item):
            if item[0] == f"{WORD}|t":
                spans.append((item[2], item[5]))

    Nodes(raw)
    for begin, end in reversed(spans):
        head = _SPACE.sub(b"", _TAG.match(raw, begin)[0])
        raw = raw[:begin] + re.sub(rb"\s*/?>$", b"", head) + b"/>" + raw[end:]
    return raw

