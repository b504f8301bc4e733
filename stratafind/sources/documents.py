"""PDF and Word files as tables of page and section texts: binary content in, text out, with the standard library alone.

PDF: the objects are read by scanning, streams inflated, and the text operators of each page's content run, which gives words
with their places; pages get their text in reading order, headed `[Page n]`. Fonts with encodings of their own, encryption and
object streams are not read: such a page is empty and, like pages of less than 50 characters with images, goes to the
recogniser. Word: the body is walked in order; headings 1 to 3 begin a section, tables become Markdown between `[TABLE]` marks.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

#: Pages with less text than this and an image are shown to the recogniser.
LITTLE = 50
#: Words whose tops differ by up to this share a line.
LINE = 5.0

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def plain(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"/FlateDecode" in body[: found.start()]:
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error:
            return b""
    return found[1]


def placed(content: bytes) -> list[tuple[float, float, str]]:
    """top (downwards), left and text of what a content stream shows."""
    out, stack, array = [], [], None
    x = y = lead = line_x = 0.0
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            (stack if array is None else array).append(_string(token))
        elif token == b"[":
            array = []
        elif token == b"]":
            stack.append("".join(s if isinstance(s, str) else " " * (s < -200) for s in array or ()))
            array = None
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", token):
            (stack if array is None else array).append(float(token))
        elif token[:1] == b"/":
            stack.append(token)
        else:
            numbers = [s for s in stack if isinstance(s, float)]
            if token == b"BT":
                x = y = line_x = 0.0
            elif token in (b"Td", b"TD") and len(numbers) > 1:
                line_x, y = line_x + numbers[-2], y + numbers[-1]
                x, lead = line_x, -numbers[-1] if token == b"TD" else lead
            elif token == b"Tm" and len(numbers) > 5:
                line_x, y = numbers[-2:]
                x = line_x
            elif token == b"TL" and numbers:
                lead = numbers[-1]
            elif token == b"T*":
                x, y = line_x, y - lead
            elif token in (b"Tj", b"TJ", b"'", b'"') and stack and isinstance(stack[-1], str):
                if token in (b"'", b'"'):
                    x, y = line_x, y - lead
                out.append((-y, x, stack[-1]))
                x += len(stack[-1])
            stack = []
    return out


def in_order(words: list[tuple[float, float, str]]) -> str:
    """Lines from the top, each from the left."""
    lines: list[list[tuple[float, float, str]]] = []
    for w in sorted(words, key=lambda w: w[0]):
        if lines and w[0] - lines[-1][-1][0] <= LINE:
            lines[-1].append(w)
        else:
            lines.append([w])
    return "\n".join(" ".join(" ".join(t for _, _, t in sorted(line, key=lambda w: w[1])).split()) for line in lines)


def pdf_pages(data: bytes) -> list[tuple[int, str, bool]]:
    """number, text and whether it has an image, of each page."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    refs = lambda body, key: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)) else []
    pages, todo = [], [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)][:1]
    todo = refs(objects[todo[0]], rb"/Pages") if todo else []
    while todo:
        n = todo.pop(0)
        body = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages\b", body):
            todo = refs(body, rb"/Kids") + todo
        elif re.search(rb"/Type\s*/Page\b", body):
            content = b"\n".join(_stream(objects.get(c, b"")) for c in refs(body, rb"/Contents"))
            pages.append((len(pages) + 1, in_order(placed(content)), b"/Image" in body or b" Do" in content))
    return pages


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_sections(data: bytes) -> list[tuple[str, str]]:
    """title and text of each section."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out: list[tuple[str, list[str]]] = [("", [])]
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and re.fullmatch(r"Heading ?[1-3]", style.get(f"{_W}val", "")):
                out.append((text(e).strip(), []))
            elif text(e).strip():
                out[-1][1].append(text(e))
        elif e.tag == f"{_W}tbl":
            rows = [[text(c).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            rule = ["| " + " | ".join("---" for _ in rows[0]) + " |"] if rows else []
            out[-1][1].append("\n".join(["[TABLE]", *lines[:1], *rule, *lines[1:], "[/TABLE]"]))
    return [(title, "\n".join(lines)) for title, lines in out if title or lines]


def _files(files: DataFrame, fn, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows = [(path.as_py(), *r) for r in fn(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=names)

    return files.where("content IS NOT NULL").select("path", "content").mapInArrow(run, schema)


def load_pdf(files: DataFrame, recognise=None) -> DataFrame:
    """path, page_number, total_pages, used_ocr, text of files(path, content); recognise(content, page): text of a picture of it.

    A file that cannot be read has no rows; an empty table gives none.
    """

    def of(data: bytes):
        pages = pdf_pages(data)
        for n, text, pictured in pages:
            seen = recognise(data, n) if recognise and pictured and len(text) < LITTLE else ""
            yield n, len(pages), bool(seen), f"[Page {n}]\n{seen or text}"

    return _files(files, of, "path string, page_number int, total_pages int, used_ocr boolean, text string")


def load_docx(files: DataFrame) -> DataFrame:
    """path, ord, section_title, sections (all titles of the file, `|` between), text of files(path, content)."""

    def of(data: bytes):
        found = docx_sections(data)
        titles = "|".join(t for t, _ in found if t)
        for k, (title, text) in enumerate(found):
            yield k, title, titles, text

    return _files(files, of, "path string, ord int, section_title string, sections string, text string")


def load_image(files: DataFrame, recognise) -> DataFrame:
    """path, page_number, used_ocr, text: a picture's text by the recogniser, headed like a first page; none gives an empty page."""

    def of(data: bytes):
        seen = recognise(data, 1)
        yield 1, bool(seen), f"[Page 1]\n{seen}"

    return _files(files, of, "path string, page_number int, used_ocr boolean, text string")


def described(files: DataFrame, describe) -> DataFrame:
    """path, description of pictures(path, content); a provider that fails gives an empty one."""

    def of(data: bytes):
        try:
            yield (describe(data) or "",)
        except Exception:  # the provider's, whatever it is: a picture without words is no error
            yield ("",)

    return _files(files, of, "path string, description string")


# ---- writers, so that other tables can be read back as files


def as_pdf(lines: list[str], per_page: int = 40) -> bytes:
    """A plain PDF of these lines, `per_page` to a page."""
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, page in enumerate(pages):
        shown = b"".join(b"1 0 0 1 50 %d Tm (%s) Tj\n" % (800 - 14 * k, re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252", "replace"))) for k, line in enumerate(page))
        packed = zlib.compress(b"BT /F1 10 Tf\n" + shown + b"ET")
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i))
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def as_docx(parts: list[tuple[str, object]]) -> bytes:
    """A Word file of ("heading", text), ("text", text) and ("table", rows)."""
    from xml.sax.saxutils import escape

    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    made = []
    for kind, value in parts:
        if kind == "table":
            made.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in value) + "</w:tbl>")
        else:
            style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind == "heading" else ""
            made.append(f"<w:p>{style}{run(value)}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(made)}</w:body></w:document>')
    return out.getvalue()


def rendered(rows: DataFrame, make, columns: list[str]) -> DataFrame:
    """path, content: make(values) of each row, where the path is the first column."""

    @F.udf("binary", useArrow=True)
    def content(*values):
        return make(*values)

    return rows.select(F.col(columns[0]).alias("path"), content(*map(F.col, columns[1:])).alias("content"))
