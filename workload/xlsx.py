"""A minimal workbook writer for the workbook query and tests."""

from __future__ import annotations

import io
import sys
import zipfile
from xml.sax.saxutils import escape

from pyspark import cloudpickle

# Spark tasks call these functions; ship them with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(value, where: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{where}"><v>{value!r}</v></c>'
    if isinstance(value, tuple):  # (style, number)
        return f'<c r="{where}" s="{value[0]}"><v>{value[1]!r}</v></c>'
    return (f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}'
            "</t></is></c>")


def workbook_bytes(rows, styles: str | None = None, shared: list[str] | None = None) -> bytes:
    """One sheet with the given rows; a ``None`` row is left out of the file."""
    body = "".join(
        f'<row r="{r + 1}">' + "".join(_cell(v, f"{_letters(c)}{r + 1}")
                                       for c, v in enumerate(row)) + "</row>"
        for r, row in enumerate(rows) if row is not None)
    parts = {
        "xl/workbook.xml": f'<workbook {_NS} xmlns:r="{_REL}"><sheets>'
                           '<sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/>'
            "</Relationships>",
        "xl/worksheets/sheet1.xml": f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>",
    }
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {_NS}>{styles}</styleSheet>"
    if shared is not None:
        parts["xl/sharedStrings.xml"] = (
            f"<sst {_NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
