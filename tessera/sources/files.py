"""Files into pages: PDF, DOCX, DOC, XLSX, XLS and HTML through one dispatch, in Arrow batches over binary files.

What the standard library can read is read with it (DOCX, XLSX, HTML); PDF and XLS need optional libraries and DOC needs a
program on the executors. A file that can't be read gives a row with its error and no pages, so one bad file fails nothing.
"""

from __future__ import annotations

import io
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import shipped

PAGE_CHARS, SHEET_ROWS, SHEET_COLUMNS = 12_000, 5_000, 50
KINDS = {"pdf": ["pdf"], "docx": ["docx"], "doc": ["doc"], "xls": ["xls"], "xlsx": ["xlsx", "xlsm"], "html": ["html", "htm", "asp", "aspx"]}
SCHEMA = "path string, kind string, title string, pages array<string>, links array<struct<page_no:int,uri:string,text:string>>, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def scan(spark: SparkSession, folder: str, kinds: list[str] | None = None) -> DataFrame:
    """All files of the kinds under a folder, as path, content and file facts."""
    endings = [e for k in (kinds or KINDS) for e in KINDS[k]]
    pattern = "*.{" + ",".join(x for e in endings for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def packed(parts: list[str], most: int = PAGE_CHARS) -> list[str]:
    """Parts joined into pages; a new page begins where their lengths would pass `most`."""
    pages, own, size = [], [], 0
    for part in parts:
        if own and size + len(part) > most:
            pages.append("\n\n".join(own))
            own, size = [], 0
        own.append(part)
        size += len(part)
    return [*pages, "\n\n".join(own)] if own else pages or [""]


def charset(data: bytes) -> str:
    """By byte order mark, then what the first 4 KB of markup declare, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    found = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", data[:4096], re.I)
    return found[1].decode("ascii").lower() if found else "utf-8"


def decoded(data: bytes) -> str:
    name = charset(data)
    try:
        text = data.decode(name, "replace")
    except LookupError:
        name, text = "utf-8", data.decode("utf-8", "replace")
    return data.decode("windows-1252", "replace") if name == "utf-8" and "�" in text else text


class _Blocks(HTMLParser):
    BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol blockquote pre header footer nav aside main form".split())
    UNSEEN = frozenset("script style noscript noframes template".split())
    ASIDE = frozenset("nav header footer aside form".split())

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[tuple[str, bool]] = []
        self.own: list[str] = []
        self.title, self.unseen, self.aside, self.in_title = "", 0, 0, False

    def _flush(self) -> None:
        if text := " ".join("".join(self.own).split()):
            self.parts.append((text, self.aside > 0))
        self.own = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BREAKS:
            self._flush()
        elif tag in ("td", "th"):
            self.own.append(" | " if "".join(self.own).strip() else "")
        self.unseen += tag in self.UNSEEN
        self.aside += tag in self.ASIDE
        self.in_title = tag == "title"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BREAKS:
            self._flush()
        self.unseen = max(0, self.unseen - (tag in self.UNSEEN))
        self.aside = max(0, self.aside - (tag in self.ASIDE))
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.unseen:
            self.own.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def read_html(data: bytes) -> tuple[str, list[str], list]:
    """Main text with tables as bars, all text where there is none, packed into pages."""
    parser = _Blocks()
    parser.feed(decoded(data))
    parser.close()
    main = [t for t, aside in parser.parts if not aside] or [t for t, _ in parser.parts]
    return " ".join(parser.title.split()), packed(main), []


def read_docx(data: bytes) -> tuple[str, list[str], list]:
    """One page for each section that a heading begins."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        root = ElementTree.fromstring(file.read("word/document.xml"))
    pages: list[list[str]] = [[]]
    for paragraph in root.iter(_WORD + "p"):
        text = "".join(t.text or "" for t in paragraph.iter(_WORD + "t")).strip()
        style = paragraph.find(f"{_WORD}pPr/{_WORD}pStyle")
        if style is not None and "heading" in style.get(_WORD + "val", "").lower() and pages[-1]:
            pages.append([])
        if text:
            pages[-1].append(text)
    return "", ["\n".join(p) for p in pages if p] or [""], []


def sheet_pages(name: str, rows: list[list[str]], per_page: int = 1, shared: int = 0) -> list[str]:
    """Rows as `header: value`, `per_page` of them on a page, `shared` repeated on the next; row 1 has headers if any."""
    rows = [r[:SHEET_COLUMNS] for r in rows[:SHEET_ROWS]]
    heads = rows[0] if rows and any(c.strip() for c in rows[0]) else []
    body = [(i, r) for i, r in enumerate(rows[1:] if heads else rows, 2 if heads else 1) if any(c.strip() for c in r)]
    pages, step = [], max(1, per_page - shared)
    for first in range(0, len(body), step):
        part = body[first : first + per_page]
        lines = []
        for _, row in part:
            named = [((heads[i].strip() if i < len(heads) else "") or f"Spalte{i + 1}", c.strip()) for i, c in enumerate(row)]
            lines.append(" | ".join(f"{h}: {c}" for h, c in named if c))
        pages.append(f"Sheet: {name} (Zeilen {part[0][0]}-{part[-1][0]})\n" + "\n".join(lines))
        if first + per_page >= len(body):
            break
    return pages


def _plain(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def read_xlsx(data: bytes) -> tuple[str, list[str], list]:
    """Every non-empty row of every sheet is a page."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        names = set(file.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(_SHEET + "t")) for s in ElementTree.fromstring(file.read("xl/sharedStrings.xml")).iter(_SHEET + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
        pages: list[str] = []
        for sheet in ElementTree.fromstring(file.read("xl/workbook.xml")).iter(_SHEET + "sheet"):
            rows = []
            path = targets[sheet.get(_REL)].lstrip("/")
            for row in ElementTree.fromstring(file.read(path if path.startswith("xl/") else f"xl/{path}")).iter(_SHEET + "row"):
                cells: list[str] = []
                for cell in row.iter(_SHEET + "c"):
                    letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                    column = 0
                    for letter in letters:
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = cell.find(_SHEET + "v")
                    text = "".join(t.text or "" for t in cell.iter(_SHEET + "t")) if value is None else value.text or ""
                    if cell.get("t") == "s":
                        text = shared[int(text)]
                    elif cell.get("t") == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif value is not None and re.fullmatch(r"-?\d+\.0+", text):
                        text = text.split(".")[0]
                    cells.append(text)
                rows.append(cells)
            pages += sheet_pages(sheet.get("name", ""), rows)
    return "", pages or [""], []


def read_xls(data: bytes) -> tuple[str, list[str], list]:
    import xlrd  # optional

    book = xlrd.open_workbook(file_contents=data)
    pages = []
    for sheet in book.sheets():
        pages += sheet_pages(sheet.name, [[_plain(bool(c.value) if c.ctype == 4 else c.value) for c in sheet.row(i)] for i in range(sheet.nrows)])
    return "", pages or [""], []


def read_pdf(data: bytes) -> tuple[str, list[str], list]:
    import fitz  # optional

    pages, links = [], []
    with fitz.open(stream=data, filetype="pdf") as document:
        for number, page in enumerate(document, 1):
            pages.append(page.get_text().strip())
            links += [(number, link["uri"], page.get_textbox(link["from"]).strip() or None) for link in page.get_links() if str(link.get("uri", "")).startswith("http")]
    return "", pages, links


def read_doc(data: bytes) -> tuple[str, list[str], list]:
    for command in (["antiword", "-w", "0", "-"], ["catdoc", "-w", "-"]):
        try:
            text = subprocess.run(command, input=data, capture_output=True, timeout=60, check=False).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.TimeoutExpired):
            continue
        if text.strip():
            return "", packed([p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]), []
    raise ValueError("neither antiword nor catdoc gave any text")


READERS: dict[str, Callable[[bytes], tuple[str, list[str], list]]] = {"pdf": read_pdf, "docx": read_docx, "doc": read_doc, "xls": read_xls, "xlsx": read_xlsx, "html": read_html}
_KIND_OF = {e: k for k, endings in KINDS.items() for e in endings}


def extracted(files: DataFrame) -> DataFrame:
    """path, kind, title, pages, links and error of every file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                kind = _KIND_OF.get(path.rpartition(".")[2].lower())
                name = path.rpartition("/")[2].rpartition(".")[0]
                try:
                    if kind is None:
                        raise ValueError("files of this kind are not supported")
                    title, pages, links = READERS[kind](content)
                    error = None
                except Exception as problem:  # noqa: BLE001  whatever a foreign file does to a reader is that file's error
                    title, pages, links, error = "", None, None, f"{type(problem).__name__}: {problem}"
                rows.append({"path": path, "kind": kind, "title": title or name, "pages": pages, "links": [dict(zip(("page_no", "uri", "text"), x)) for x in links] if links is not None else None, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    shipped(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("title", pa.string()), ("pages", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("page_no", pa.int32()), ("uri", pa.string()), ("text", pa.string())]))), ("error", pa.string())])


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The addresses of a text file, without blank lines and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON file, with defaults for what they leave out."""
    schema = "test_cases array<struct<query:string,relevant_doc_ids:array<string>,expected_answer_contains:array<string>,category:string>>"
    cases = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("test_cases").alias("case_id", "c"))
    none = F.array().cast("array<string>")
    return cases.select("case_id", "c.query", F.coalesce("c.relevant_doc_ids", none).alias("relevant_doc_ids"), F.coalesce("c.expected_answer_contains", none).alias("expected_answer_contains"), F.coalesce("c.category", F.lit("general")).alias("category"))


def evaluation_results(results: DataFrame, path: str) -> None:
    """Writes evaluated cases (case_id, query, category, passed, latency_ms and metrics of any kind) under a path.

    `cases` has a JSON line for each case, `summary` one line: how many there were and passed, the mean latency, and the same by category.
    """
    counts = [F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.avg("latency_ms").alias("avg_latency_ms")]
    by_category = results.groupBy("category").agg(*counts).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("total", "passed", "avg_latency_ms")))).alias("by_category"))
    results.write.mode("overwrite").json(f"{path}/cases")
    results.agg(*counts).crossJoin(by_category).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str | None, bytes]], most: int = 100 << 20) -> DataFrame:
    """url, status, etag, content and error of each address, by a function that the caller supplies; larger bodies are left out.

    What the function throws is the error of its address, with status 0; the others go on.
    """
    schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("etag", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                try:
                    status, etag, body = fetch(url)
                    error = None
                except Exception as problem:  # noqa: BLE001  the network's and the caller's errors are of any kind
                    status, etag, body, error = 0, None, None, f"{type(problem).__name__}: {problem}"
                rows.append({"url": url, "status": status, "etag": etag, "content": body if body is not None and len(body) <= most else None, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    shipped(urls.sparkSession)
    return urls.select("url").mapInArrow(run, "url string, status int, etag string, content binary, error string")
