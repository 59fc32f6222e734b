"""Words of letters, digits and characters beyond ASCII, and stated query sets (benchmark items) in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a block of items holds on average at most; a block is what one broadcast carries.
ITEM_BYTES = 8 << 20
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes beyond ASCII (so every byte of a longer character), makes the rest spaces.
_TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def word_pieces(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of about `piece` bytes of text; nothing for null."""
    text = (text or b"").translate(_TO_WORDS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def words_of(text: bytes | None) -> list[bytes]:
    return [w for piece in word_pieces(text) for w in piece]


def item_blocks(items: DataFrame, block_bytes: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """Distinct (item_id, text as bytes) rows in blocks whose size is checked first, one at a time on the driver.

    Rows are dealt by a hash of id and text, so a text that very many items share is spread as well.
    """
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        if found := [tuple(r) for r in mine.collect()]:
            yield sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
