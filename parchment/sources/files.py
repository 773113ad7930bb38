"""Documents from files: Word packages, older Word files, PDFs through a plug-in, archives of them, HTML.

Everything is read with Spark's binaryFile source; nothing is written into the source folder.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment

PRIORITY = ("docx", "doc", "pdf")
#: The namespaces of a Word package's main part.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp"}
SALVAGED = (20, 50)  # characters of a run, and of all runs, at least
IMAGE = "array<struct<image_index:int,paragraph:int,section:string,caption:string,mime:string,data:binary>>"
_HEADS = {c: re.compile(rf"(?i:{p})") for c, p in segment.HEADINGS.items()}
PARSED = f"text string, paragraphs int, tables int, figures int, images {IMAGE}, error string"
Parser = Callable[[bytes], str]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))


def best(files: DataFrame, name: str = "name") -> DataFrame:
    """The file of each author with the best extension, then the first by name; other kinds of files go."""
    ranked = files.withColumns({"author": T.author_key(F.col(name)), "_rank": F.array_position(F.lit(list(PRIORITY)), extension(F.col(name)))}).where("_rank > 0")
    w = Window.partitionBy("author").orderBy("_rank", name)
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).withColumn("file", F.regexp_extract("path", r"([^/]+)\z", 1))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, member) of the documents in a folder, and of those in its archives, renamed after the archive; no document is read."""
    found = _binary(spark, folder)
    loose = found.where(extension(F.col("file")).isin(*PRIORITY)).select(F.col("file").alias("name"), "path", F.lit(None).cast("string").alias("member"))
    packed = found.where(extension(F.col("file")) == "zip").select("file", "path", "content").mapInPandas(_listed, "name string, path string, member string")
    return loose.unionByName(packed.join(loose.select("name"), "name", "left_anti").groupBy("name").agg(F.min(F.struct("path", "member")).alias("m")).select("name", "m.*"))


def contents(spark: SparkSession, folder: str, chosen: DataFrame) -> DataFrame:
    """`chosen` (name, path, member, ...) with the content of each document instead of path and member."""
    held = _binary(spark, folder).select("path", "content").join(chosen, "path")
    kinds = ", ".join(f"`{c}` {k}" for c, k in chosen.dtypes if c not in ("path", "member"))
    whole = held.where("member is null").drop("path", "member")
    return whole.unionByName(held.where("member is not null").drop("path").mapInPandas(_member, f"content binary, {kinds}"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of all documents in a folder and in its archives."""
    return contents(spark, folder, names(spark, folder)).select("name", "content")


def members(archive, name: str) -> Iterator[tuple[str, str]]:
    """(document, member): what an archive's documents are called after it, the first member of each kind; `archive` is an open file."""
    try:
        with zipfile.ZipFile(archive) as z:
            found = sorted(z.namelist())
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return  # an archive that cannot be read holds no documents
    seen = set()
    for member in found:
        kind = PurePosixPath(member).suffix.lower()
        target = PurePosixPath(name).stem + kind
        if kind[1:] in PRIORITY and target not in seen and not PurePosixPath(member).name.startswith(("~$", ".")):
            seen.add(target)
            yield target, member


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = [(target, path, member) for name, path, content in zip(f["file"], f["path"], f["content"], strict=True) for target, member in members(io.BytesIO(content), name)]
        yield pd.DataFrame(out, columns=["name", "path", "member"])


def _member(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def read(content: bytes, member: str) -> bytes:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return z.read(member)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
            return b""  # the parser tells why there is no text

    for f in frames:
        f["content"] = [read(c, m) for c, m in zip(f["content"], f["member"], strict=True)]
        yield f.drop(columns=["member"])


def requirements(path: str | Path, fallback: Parser | None = None) -> str:
    """The text of a requirements document, a stripped line each; raises if the file is missing or has no text."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    content = path.read_bytes()
    text = parse_one(path.name, content, fallback)["text"] or (content.decode("utf-8", "replace") if path.suffix.lower() in (".txt", ".md", "") else "")
    found = "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)
    if not found:
        raise ValueError(f"{path} has no text")
    return found


def compressed(data: bytes, width: int = 1024, least: int = 20) -> bytes | None:
    """An image at most `width` wide, its ratio kept; nothing if a side is under `least`. Without an image library the bytes stay as they are."""
    try:
        from PIL import Image
    except ImportError:
        return data
    image = Image.open(io.BytesIO(data))
    if image.width > width:
        image = image.resize((width, int(image.height * width / image.width)))
    if min(image.size) < least:
        return None
    out = io.BytesIO()
    image.save(out, image.format or "PNG")
    return out.getvalue()


def docx(content: bytes) -> dict:
    """Text, counts and images of a Word package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = set(z.namelist())
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            rels = {r.get("Id"): r for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{PACKAGE}Relationship")}
        paragraphs = [p for p in body if p.tag == f"{WORD}p"]
        texts = ["".join(x.text or "" if x.tag == f"{WORD}t" else "\t" if x.tag == f"{WORD}tab" else "\n" for x in p.iter() if x.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br")).strip() for p in paragraphs]
        images, section = [], "header"
        for i, p in enumerate(paragraphs):
            section = next((c for c, h in _HEADS.items() if h.match(texts[i])), section)
            for blip in p.iter(f"{DRAWING}blip"):
                rel = rels.get(blip.get(f"{RELATION}embed"))
                part = rel is not None and str(PurePosixPath("word") / rel.get("Target", "")).replace("word//", "")
                if not part or part not in names:
                    continue
                following = texts[i + 1] if i + 1 < len(texts) else ""
                caption = texts[i][:200] or (following if 0 < len(following) < 200 else section)
                images.append((len(images) + 1, i, section, caption, TYPES.get(part.rsplit(".", 1)[-1].lower(), "image/png"), z.read(part)))
    figures = sum("image" in r.get("Type", "") for r in rels.values())
    return {"text": "\n".join(t for t in texts if t), "paragraphs": len(paragraphs), "tables": sum(1 for x in body if x.tag == f"{WORD}tbl"), "figures": figures, "images": images, "error": None}


def plain(text: str, figures: int = 0) -> dict:
    if not text.strip():
        raise ValueError("no text")
    return {"text": text, "paragraphs": sum(1 for x in text.split("\n") if x.strip()), "tables": 0, "figures": figures, "images": [], "error": None}


def salvage(content: bytes) -> str:
    """Readable UTF-16 runs of an older Word file; nothing if there is too little."""
    runs = re.split("[^\n\r\t -~ -퟿豈-�]+", content[: len(content) // 2 * 2].decode("utf-16-le", "replace").replace("�", "\0"))
    text = "\n".join(r for r in runs if len(r) > SALVAGED[0])
    return text if len(text) >= SALVAGED[1] else ""


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "nav"}

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html(content: bytes) -> str:
    reader = _Text()
    reader.feed(content.decode("utf-8", "replace"))
    return "\n".join(x for x in (line.strip() for line in "".join(reader.out).split("\n")) if x)


def parse_one(name: str, content: bytes, fallback: Parser | None = None, pdf: Parser | None = None) -> dict:
    """The first strategy that gives text; else the reason in `error`."""
    kind, error = PurePosixPath(name).suffix.lower()[1:], "no text"
    tries: list[Callable[[], dict]] = []
    if kind in ("docx", "doc") and content[:2] == b"PK":
        tries.append(lambda: docx(content))
    if kind == "doc":
        tries.append(lambda: plain(salvage(content)))
    if kind == "pdf" and pdf:
        tries.append(lambda: plain(pdf(content)))
    if kind in ("html", "htm"):
        tries.append(lambda: plain(html(content)))
    if fallback:
        tries.append(lambda: plain(fallback(content)))
    for attempt in tries:
        try:
            return attempt()
        except Exception as e:  # noqa: BLE001  a damaged file must not end the job; the next strategy follows
            error = f"{type(e).__name__}: {e}"
    return {"text": None, "paragraphs": 0, "tables": 0, "figures": 0, "images": [], "error": error}


def parsed(found: DataFrame, fallback: Parser | None = None, pdf: Parser | None = None) -> DataFrame:
    """`found` (name, content, ...) with the columns of PARSED instead of the content."""
    rest = [(c, k) for c, k in found.dtypes if c != "content"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_one(n, bytes(c), fallback, pdf) for n, c in zip(f["name"], f["content"], strict=True)]
            keys = ("image_index", "paragraph", "section", "caption", "mime", "data")
            for r in rows:
                r["images"] = [dict(zip(keys, x, strict=True)) for x in r["images"]]
            new = pd.DataFrame(rows, columns=["text", "paragraphs", "tables", "figures", "images", "error"], index=f.index)
            yield pd.concat([f.drop(columns=["content"]), new], axis=1)

    return found.mapInPandas(read, ", ".join([*(f"`{c}` {k}" for c, k in rest), PARSED]))


def directory(spark: SparkSession, folder: str, **parsers: Parser) -> DataFrame:
    """A document per author, from the best of their files; files are chosen by name and only then read."""
    return parsed(contents(spark, folder, best(names(spark, folder))), **parsers)
