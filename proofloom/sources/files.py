"""Reports as files: Word and PDF made of Markdown, and a sink that writes one file a document in two phases."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Colours of verdicts and severities in reports.
COLOURS = {"BLOCK": "B00020", "FATAL": "B00020", "REVIEW": "B36B00", "MAJOR": "B36B00", "PASS": "1B7F3B"}
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def blocks(lines: list[str]) -> list[tuple[str, int, object]]:
    """(kind, level, content) of Markdown: head, item, table (rows of cells) and line; blank lines part them and go."""
    out: list[tuple[str, int, object]] = []
    for line in lines:
        head = re.match(r"(#{1,6})\s+(.*)", line)
        if re.fullmatch(r"\|[\s:|-]+\|", line):
            continue  # the rule under a table's head
        if line.startswith("|") and line.rstrip().endswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if out and out[-1][0] == "table":
                out[-1][2].append(cells)
            else:
                out.append(("table", 0, [cells]))
        elif head:
            out.append(("head", len(head[1]), head[2]))
        elif line.startswith("- "):
            out.append(("item", 0, line[2:]))
        elif line.strip():
            out.append(("line", 0, line))
        elif out and out[-1][0] == "table":
            out.append(("gap", 0, ""))
    return [b for b in out if b[0] != "gap"]


def colour_of(text: str) -> str | None:
    return next((c for word, c in COLOURS.items() if re.search(rf"\b{word}\b", text)), None)


def docx_bytes(lines: list[str]) -> bytes:
    """A Word file of Markdown lines: headings by style, tables with borders, items indented, verdicts in colour."""

    def run(text: str, bold: bool = False) -> str:
        colour = colour_of(text)
        look = "<w:b/>" * bold + (f'<w:color w:val="{colour}"/>' if colour else "")
        return f'<w:r><w:rPr>{look}</w:rPr><w:t xml:space="preserve">{escape(_printable(text))}</w:t></w:r>'

    def paragraph(text: str, style: str = "", bold: bool = False) -> str:
        return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{run(text, bold)}</w:p>"

    body = []
    for kind, level, content in blocks(lines):
        if kind == "table":
            edge = "".join(f'<w:{e} w:val="single" w:sz="4" w:color="999999"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c, bold=n == 0)}</w:tc>" for c in row) + "</w:tr>" for n, row in enumerate(content))
            body.append(f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>{rows}</w:tbl>")
        else:
            body.append(paragraph(content, {"head": f"Heading{level}", "item": "ListItem"}.get(kind, "")))
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{38 - 4 * n}"/></w:rPr></w:style>' for n in range(1, 7))
    item = '<w:style w:type="paragraph" w:styleId="ListItem"><w:name w:val="List Item"/><w:pPr><w:ind w:left="360"/></w:pPr></w:style>'
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{main}.styles+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{_W}">{heads}{item}</w:styles>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _printable(text: str) -> str:
    """Without the control characters that XML cannot hold."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


WIDTH, HEIGHT, EDGE = 595, 842, 50


def advance(text: str, wide: bool) -> float:
    """Width in ems at most: full-width type sets every character in one, Helvetica none wider than this."""
    return float(len(text)) if wide else sum(1.0 if c in "@%mwMW—…" else 0.8 if c.isupper() else 0.6 for c in text)


def wrapped(text: str, size: float, wide: bool) -> list[str]:
    """Lines no wider than the page: cut at blanks, within a word only if it is too long by itself."""
    most = (WIDTH - 2 * EDGE) / size
    out, line = [], ""
    for word in re.findall(r"\S+\s*|\s+", text) or [""]:
        while True:
            if advance((line + word).rstrip(), wide) <= most:
                line += word
                break
            if line.strip() and (advance(word.rstrip(), wide) <= most or not wide):
                out.append(line.rstrip())
                line = ""
                continue
            room = next((n for n in range(len(word), 0, -1) if advance(line + word[:n], wide) <= most), 0)
            if not room and not line:
                room = 1
            out.append((line + word[:room]).rstrip())
            line, word = "", word[room:]
    out.append(line.rstrip())
    return out


def pdf_bytes(lines: list[str], font: str = "STSong-Light") -> bytes:
    """A PDF of Markdown lines, wrapped to the page, headings larger (K07). Texts beyond Latin are set in a font that PDF readers
    bring for CJK, by UCS-2 code."""
    wide = any(ord(c) > 255 for line in lines for c in line)
    if wide:
        shown = lambda x: "<" + x.encode("utf-16-be", "replace").hex() + ">"
        font_of = f"<< /Type /Font /Subtype /Type0 /BaseFont /{font} /Encoding /UniGB-UCS2-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 /BaseFont /{font} /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /DW 1000 >>] >>"
    else:
        shown = lambda x: "(" + x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ")"
        font_of = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    set_lines = []  # (size, colour, text)
    for kind, level, content in blocks(lines):
        texts = [" | ".join(row) for row in content] if kind == "table" else [("• " if wide else "- ") * (kind == "item") + content]
        size = 18 - 2 * min(level, 3) if kind == "head" else 10
        for t in texts:
            c = colour_of(t) or "000000"
            set_lines += [(size, c, part) for part in wrapped(_printable(t), size, wide)]
    pages, y = [[]], HEIGHT - EDGE
    for size, colour, text in set_lines:
        y -= size * 1.3
        if y < EDGE:
            pages.append([])
            y = HEIGHT - EDGE - size * 1.3
        red, green, blue = (int(colour[i : i + 2], 16) / 255 for i in (0, 2, 4))
        pages[-1].append(f"{red:.2f} {green:.2f} {blue:.2f} rg BT /F1 {size} Tf {EDGE} {y:.1f} Td {shown(text)} Tj ET\n")
    objects, kids = ["<< /Type /Catalog /Pages 2 0 R >>", "", font_of], []
    for page in pages:
        stream = "".join(page)
        objects.append(f"<< /Length {len(stream.encode('latin-1', 'replace'))} >>\nstream\n{stream}\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects)} 0 R >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{o}\nendobj\n".encode("latin-1", "replace")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


MAKERS = {"docx": docx_bytes, "pdf": pdf_bytes, "md": lambda lines: "\n".join(lines).encode(), "html": lambda lines: "\n".join(lines).encode(), "json": lambda lines: "\n".join(lines).encode()}
STAGING = "_staged"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder in the staging area, and how many files."""

    folder: str
    files: int


def file_name(doc_id: object, seen: dict[str, int], kind: str) -> str:
    """A name of the id, safe in any store; further rows of one id get numbers."""
    stem = re.sub(r"[^\w.-]", "_", str(doc_id))[:120] or "_"
    seen[stem] = seen.get(stem, 0) + 1
    return f"{stem}{f'~{seen[stem]}' if seen[stem] > 1 else ''}.{kind}"


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = path.rstrip("/"), kind, overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def opened(self) -> _Writer:
        """The job's staging folder is made before any task runs and taken away at its end: a task that is still at work when
        the job is given up finds no place to write."""
        store, root = self._store()
        store.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)
        return self

    def write(self, iterator) -> Written:
        """Files of one task, each attempt in a folder of its own: one that fails leaves nothing that commit would move."""
        store, root = self._store()
        folder, seen, make = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", {}, MAKERS[self.kind]
        for row in iterator:
            if not seen:
                store.create_dir(f"{root}/{folder}", recursive=False)
            with store.open_output_stream(f"{root}/{folder}/{file_name(row[0], seen, self.kind)}") as out:
                out.write(make((row[1] or "").split("\n")))
        return Written(folder if seen else "", sum(seen.values()))

    def commit(self, messages) -> None:
        """Move each task's folder into place, one move a task, and list them; then the staging area goes."""
        store, root = self._store()
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")] if self.overwrite else []
        told = []
        for n, m in enumerate(m for m in messages if m and m.folder):
            name = f"part-{self.job[:8]}-{n:05d}"
            store.move(f"{root}/{m.folder}", f"{root}/{name}")
            told.append({"folder": name, "files": m.files})
        for folder in old:
            store.delete_dir(folder)
        with store.open_output_stream(f"{root}/_committed-{self.job[:8]}.json") as out:
            out.write(json.dumps(told).encode())
        self._clean(store, root)

    def abort(self, messages) -> None:
        self._clean(*self._store())

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


class ReportFiles(DataSource):
    """Rows (doc_id, report) as files of a kind (docx, pdf, md, html, json), each in a folder of its task."""

    @classmethod
    def name(cls) -> str:
        return "proofloom_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("kind", "md"), overwrite).opened()


def write_files(reports: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Write reports (doc_id and a text: Markdown for docx, pdf and md) as one file a row under path, in a store that Arrow's
    file systems reach from driver and executors. Files are there when the whole job has ended well, or not at all."""
    reports.sparkSession.dataSource.register(ReportFiles)
    columns = reports.columns
    reports.selectExpr(f"CAST(`{columns[0]}` AS STRING) AS doc_id", f"CAST(`{columns[1]}` AS STRING) AS report").write.format(ReportFiles.name()).option("kind", kind).mode(mode).save(path)
