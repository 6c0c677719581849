"""Media columns: interleaved document sequences.

A page becomes an ordered list of items: texts, and references to media with their digest and
caption. Media are stored once for each digest and task, as grey images; a join on digests resolves
the references, and every item keeps its position and caption. sequences() gives each page's whole
list with the stored bytes in it. text_media() takes every document as a page of its own, with a
heading, its text as an image and its text as paragraphs; it joins what is computed from the stored
bytes, read back, so that bytes are not exchanged.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_tree
from .scratch import save

WIDTH = 64
SCHEME = "sha256:"
SEEN = 500_000  # digests that a task knows again; others may be stored twice


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def store(data: bytes) -> bytes:
    """A grey image of 8-bit samples, 64 to a row, in the portable graymap format; lossless."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s")


def load(stored: bytes) -> np.ndarray:
    """The samples of a stored image, by rows."""
    m = HEADER.match(stored)
    if not m or m[3] != b"255":
        raise ValueError("not a graymap of 8-bit samples")
    width, height = int(m[1]), int(m[2])
    return np.frombuffer(stored, np.uint8, width * height, m.end()).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation and entropy of the samples, the mean step between neighbours, and a difference hash of 8 by 8 cells."""
    height, width = samples.shape
    n = samples.size
    counts = np.bincount(samples.ravel(), minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / n
    deviation = max(0.0, float(counts @ (level * level)) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    edges = np.unique(np.linspace(0, height, 9).astype(int)[:-1])
    cells = np.add.reduceat(samples, edges, 0, dtype=np.int64)
    cells = np.add.reduceat(cells, np.arange(0, width, max(1, width // 9))[:9], 1)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()) if width > 1 else 0.0
    return f"rows={height};mean={mean:.6f};sd={deviation:.6f};entropy={entropy:.6f};step={step:.6f};dhash={np.packbits(bits).tobytes().hex()}"


def stored_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, n_bytes and media of the texts of docs, stored as images, once for each digest in a task; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple[str, int, bytes]] = []
            held = 0
            for x in batch.column(0).cast(pa.binary()):
                text = x.as_py() or b""
                key = hashlib.sha256(text).digest()
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                media = store(payload(text))
                rows.append((key.hex(), len(text), media))
                held += len(media)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        digest, size, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["digest", "n_bytes", "media"])

    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary")


FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: DataFrame) -> DataFrame:
    """Of each digest, its stored form and what its payload, read back, is like. One row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                stored = x.as_buffer()
                samples = load(stored)
                back = samples.reshape(-1)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if out:
                size, sha, crc, n, whole, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (size, sha, crc, n, whole, text))], names=[c.split()[0] for c in FACTS.split(", ")])

    found = media.select("digest", "n_bytes", "media").mapInArrow(run, FACTS)
    names = [c.split()[0] for c in FACTS.split(", ")][1:]
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in names))  # copies of a digest have equal facts


ITEM = "position int, kind string, text string, digest string, caption string"


def items(page: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """The texts and media references of a page in order: position, kind, text, digest and caption.

    A figure's captions belong to each of its images, and are no texts of their own. White space in a
    text becomes one space; character references are decoded; scripts and styles are left out.
    """
    out: list[list] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(["text", text, None, None])
        held.clear()

    # children still to come; whether a text ends with them; of a figure, its first item and its caption
    stack: list[tuple] = [(iter(html_tree.parse(page).children), True, None)]
    while stack:
        rest, ends, figure = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if ends:
                flush()
            if figure and figure[1]:
                for item in out[figure[0] :]:
                    if item[0] == "media" and item[3] is None:
                        item[3] = figure[1]
        elif child.key == "#text":
            held.append(child.text)
        elif child.key == "#raw" or child.tag in ("script", "style"):
            continue
        elif child.tag == "figure":
            flush()
            caption = " ".join(" ".join(html.unescape(_all_text(c)).split()) for c in child.children if c.tag == "figcaption")
            stack.append((iter([c for c in child.children if c.tag != "figcaption"]), True, (len(out), caption)))
        elif child.tag == "img":
            if child.text.startswith(SCHEME):
                flush()
                out.append(["media", None, child.text[len(SCHEME) :], None])
        else:
            block = child.tag not in html_tree.INLINE
            if block:
                flush()
            stack.append((iter(child.children), block, None))
    return [(k, *item) for k, item in enumerate(out)]


def _all_text(node: html_tree.Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.key == "#text":
            out.append(n.text)
        todo += reversed(n.children)
    return "".join(out)


def interleave(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """A row per text or reference of each page: id, position, kind, text, digest, caption. A null or empty page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                found = items(page) if page else []
                ids += [k] * len(found)
                rows += found
            if rows:
                position, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(position, pa.int32()), *(pa.array(x, pa.string()) for x in rest)], names=["id", "position", "kind", "text", "digest", "caption"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id long, {ITEM}")


def sequences(pages: DataFrame, media: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per row of pages: its id and items, an array in page order of position, kind, text, digest, caption and the stored media, null for a digest that media lack.

    media has a row per digest. A null or empty page has no items; null ids stay null, and repeated
    rows each get a row. References are joined without their texts; hot digests are split by the
    adaptive join; a page's items come together by the page's place in a written table.
    """
    rows = save(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")), "media-pages")
    found = save(interleave(rows, "row", "html").withColumnRenamed("id", "row"), "media-items")
    lists = resolve(found, media.select("digest", "media")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "kind", "text", "digest", "caption", "media"))).alias("items"))
    return rows.select("row", "id").join(lists, "row", "left").select("id", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)).alias("items"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """The items with what is known of their media, null for texts and for digests that no media have.

    media has a row per digest. Hot digests are split by the adaptive join; texts do not take part.
    """
    refs = sequences.where("digest is not null").join(media, "digest", "left")
    texts = sequences.where("digest is null")
    return refs.unionByName(texts, allowMissingColumns=True)


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page per row of docs: a heading, its text as an image with a caption, and its lines as paragraphs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    name = F.concat(F.lit("Document "), F.coalesce(id_.cast("string"), F.lit("?")))
    caption = F.concat(name, F.lit(", "), F.octet_length(text).cast("string"), F.lit(" bytes"))
    lines = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    page = F.concat(F.lit("<article><h1>"), name, F.lit(f'</h1><figure><img src="{SCHEME}'), F.sha2(text, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>"), lines, F.lit("</p></article>"))
    return docs.select(id_.alias("doc_id"), page.alias("html"))


SEQUENCE = "id long, position int, digest string, caption string, n_items long, n_texts long, text_chars long"


def references(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """A row per media reference of each page, with its place among the page's items and what the texts around it are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = items(page.as_py() or "")
                texts = [x[2] for x in found if x[1] == "text"]
                out += [(id_, x[0], x[3], x[4], len(found), len(texts), sum(map(len, texts))) for x in found if x[1] == "media"]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SEQUENCE.split(", ")])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, SEQUENCE)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with the facts of the media that its page refers to, and the reference's place and caption.

    Null texts are empty and take one row of zeros; equal texts share their media; null ids stay
    null; repeated rows each get a row; very long texts are stored whole; other columns are not read.
    """
    stored = save(stored_texts(docs, text_col), "media")
    found = references(text_pages(docs, id_col, text_col)).join(save(facts(stored), "media-facts"), "digest", "left")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "n_texts", "text_chars")
