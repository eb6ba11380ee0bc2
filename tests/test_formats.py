"""Format probes by content."""

import io
import zipfile

import pytest

from parallex.operators import routing


def box(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


CASES = [
    (b"II*\x00", "tiff"), (b"GIF89a", "gif"), (b"GIF8", "txt"), (b"", "txt"), (b"\xff\xfe\x00", "unknown"), (b"\x01\x02\x03 ab", "unknown"), (b"a,b\n1,2\n3,4", "csv"), (b"one line, only", "txt"), (b"- a\n* b\n", "md"), (b"[1, 2", "txt"), (b"[1, 2]", "json"),
    (box(word__document_dot_xml="x"), "docx"), (box(word__document_dot_xml="x", vbaProject_dot_bin="x"), "docm"), (box(**{"xl__workbook_dot_xml": "x", "[Content_Types]_dot_xml": "a macroEnabled b"}), "xlsm"), (box(mimetype="application/vnd.oasis.opendocument.text"), "odt"), (box(**{"META-INF__container_dot_xml": "x"}), "epub"), (box(a="b"), "zip"), (box(), "zip"), (b"PK\x03\x04 broken", "unknown"),
]


@pytest.mark.parametrize("data,name", CASES)
def test_probe(data, name):
    assert routing.probe(data) == name


def test_reports(spark):
    risks = spark.createDataFrame([("docm", ["MACRO_ENABLED", "DEDICATED"]), ("doc", ["LEGACY_CONTAINER"])], "format string, known array<string>")
    rows = [("a.docx", box(word__document_dot_xml="x", vbaProject_dot_bin="x")), ("b.DOC", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("c", None), ("d.zip", b"PK\x05\x06 broken")]
    got = {r.path: (r.declared, r.detected, r.effective, r.status, r.confidence, r.container, r.macro, r.risks, bool(r.error)) for r in routing.probed(spark.createDataFrame(rows, "path string, content binary"), risks).collect()}
    assert got == {
        "a.docx": ("docx", "docm", "docm", "CONFLICT", "HIGH", "zip", True, ["EXTENSION_CONTENT_CONFLICT", "MACRO_ENABLED", "DEDICATED"], False),
        "b.DOC": ("doc", "ole", "doc", "CONTAINER_MATCH", "MEDIUM", "ole", False, ["LEGACY_CONTAINER", "SUBTYPE_UNVERIFIED"], False),
        "c": (None, "txt", "txt", "CONTENT_ONLY", "LOW", None, False, [], False),
        "d.zip": ("zip", "unknown", "zip", "EXTENSION_ONLY", "LOW", "zip", False, ["EXTENSION_ONLY_UNVERIFIED"], True),
    }
