"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens tile its UTF-8 bytes, so running sums of token lengths are their spans.
Sections are half-open character spans, by default the lines of the text with their line ends; they are mapped to bytes and
meet the tokens in an interval join inside the document: both lists are sorted, so each section finds its tokens by binary
search. A token that crosses a boundary counts by ``rule``:

* ``first``: to the section that holds its first byte
* ``last``: to the section that holds its last byte
* ``middle``: to the section that holds its middle byte (of an even number, the left one)
* ``split``: to every section by its share of bytes

Sections that tile a text add up to its token count under every rule. Each section is counted on its own, so nested ones each
count. One pass over the texts; nothing is shuffled, and no row per token is ever made.

Edge cases: null or empty text has one empty section without tokens; spans beyond the text are clipped; a null list of sections
gives no rows, a section with a null end counts nothing and has none; a text may be of any length and be one long word, line or
run of white space; repeated rows are counted each, and sections with the same span each count the same; columns other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import table
from voxelspark.plans.iterate import bounded_batches

#: White space of the split pattern in runs so long that the pattern's look-ahead would overflow the matcher's stack.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
OUT = "section int, start long, end long, tokens double, crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """(encoding, length in bytes of each token) of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def token_ids(tool, text: str) -> list[int]:
    """ids of a whole text of any length.

    The split pattern takes a run of white space as one piece: all of it at the end of a text, all but its last character
    elsewhere. Long runs are cut there and go to the merges as they are, so ids are those of the whole text.
    """
    out, at = [], 0
    for run in BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += tool.encode_ordinary(text[at : run.start()])
        out += tool._encode_single_piece(text[run.start() : end])
        at = end
    return out + tool.encode_ordinary(text[at:]) if at else tool.encode_ordinary(text)


def tally(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by rule, tokens that cross a boundary) of each byte span low..high over tokens start..end that tile the bytes."""
    if rule == "split":
        whole = np.append(end, end[-1] if len(end) else 0)

        def upto(x):  # tokens before byte x, the one that x cuts by its share
            k = np.searchsorted(end, x, "right")
            at = np.minimum(k, max(len(end) - 1, 0))
            part = np.where(k < len(end), (x - start[at]) / np.maximum(whole[at] - start[at], 1), 0.0) if len(end) else np.zeros(len(x))
            return k + part

        count = upto(high) - upto(low)
    else:
        spot = {"first": start, "last": end - 1, "middle": start + (end - start - 1) // 2}[rule]
        count = (np.searchsorted(spot, high) - np.searchsorted(spot, low)).astype(float)
    touching = np.searchsorted(start, high) - np.searchsorted(end, low, "right")
    inside = np.maximum(np.searchsorted(end, high, "right") - np.searchsorted(start, low), 0)
    return count, np.where(high > low, touching - inside, 0)


def attribute_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing, doc_tokens): one row per section, spans in characters.

    sections_col: an array of structs whose first two fields are start and end in characters; None takes lines.
    """
    if rule not in ("first", "last", "middle", "split"):
        raise ValueError(f"unknown rule {rule}")
    bounded_batches(docs.sparkSession)
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")]
    if sections_col:
        columns.append(F.transform(F.col(sections_col), lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("spans"))
    kind = docs.select(columns[0]).schema[0].dataType.simpleString()

    def run(batches):
        tool, length = encoder(ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                spans = part.column("spans").to_pylist() if sections_col else None
                rows, out = [], []
                for k, text in enumerate(part.column("body").to_pylist()):
                    text = text or ""
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ids = np.array(token_ids(tool, text), np.int64)
                    end = np.cumsum(length[ids])
                    begin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each character
                    if spans is None:
                        breaks = np.flatnonzero(raw == 10) + 1
                        edge = np.concatenate(([0], breaks[breaks < len(raw)], [len(raw)]))
                        low, high = edge[:-1], edge[1:]
                        c_low, c_high = np.searchsorted(begin, low), np.searchsorted(begin, high)
                    else:
                        own = np.array([s for s in spans[k] or [] if s[0] is not None and s[1] is not None], np.int64).reshape(-1, 2)
                        c_low = np.clip(own[:, 0], 0, len(begin) - 1)
                        c_high = np.clip(own[:, 1], c_low, len(begin) - 1)
                        low, high = begin[c_low], begin[c_high]
                    count, crossing = tally(end - length[ids], end, low, high, rule)
                    n = len(low)
                    rows.append(np.full(n, k))
                    out.append((np.arange(n), c_low, c_high, count, crossing, np.full(n, len(ids))))
                took = np.concatenate(rows)
                if len(took):
                    section, c_low, c_high, count, crossing, total = (np.concatenate(x) for x in zip(*out, strict=True))
                    big = [pa.array(x.astype(np.int64)) for x in (c_low, c_high)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(took)), pa.array(section.astype(np.int32)), *big, pa.array(count.astype(float)), pa.array(crossing.astype(np.int64)), pa.array(total.astype(np.int64))],
                        ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"],
                    )

    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, {OUT}")


def pieces_of(text_col: str, size: int):
    """Sections of ``size`` characters each that tile a text; an empty text has one empty section."""
    length = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(length / size) - 1, F.lit(0)).cast("long"))
    return F.transform(steps, lambda i: F.struct((i * size).alias("start"), F.least((i + 1) * size, length).alias("end")))


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of each 2,000 characters of a document, a token that crosses a boundary counting by its share of bytes."""
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pieces_of("text", 2000).alias("sections"))
    return attribute_tokens(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, sections_col="sections", rule="split")
