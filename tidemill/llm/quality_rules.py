"""Line-first cleaning: per-line rules drop lines, then documents that lose too much go.

Every line of a text that holds a word is judged alone, by rules of five kinds:

* punctuation: it ends in terminal punctuation, or has ten words and terminal
  punctuation inside;
* navigation: two separators or more, one to four words at least;
* markup: more than a tenth of its characters are symbols;
* banner: more than seven tenths of its Latin letters are capitals (three
  words or more);
* boilerplate: it holds one of the fixed phrases and has at most 25 words.

Lines that fail go. A document goes if the lost lines held more than
``max_lost_percent`` of its word characters, or if it fails the base rule (too
short, or made of repeated three-word windows). Null and empty texts have no
words and fail the base rule. Rows are judged one by one, so repeated rows get
equal verdicts; there is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, exact, fresh, give_back, map_rows, texts_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "log in to",
    "newsletter", "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe now",
    "terms of service", "terms of use",
)
#: Marks that end a sentence, those of Chinese, Japanese, Hindi, Arabic and Urdu prose too. Regular expressions in the common subset of Python, Java and RE2.
END_RE = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{964}\x{965}\x{61F}\x{6D4}][\"'\x{201D}\x{2019}\x{BB})\]\x{300D}\x{300F}\x{FF09}]*$"
INSIDE_RE = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{964}\x{965}\x{61F}\x{6D4}][\"'\x{201D}\x{2019}\x{BB})\]\x{300D}\x{300F}\x{FF09}]*[ \t]"
SEPARATOR_RE = r"[|>\x{BB}\x{203A}\x{2022}\x{B7}]"
UPPER_RE, LOWER_RE = r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]", r"[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]"

_py = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p))
_END, _INSIDE, _SEPARATOR, _UPPER, _LOWER = map(_py, (END_RE, INSIDE_RE, SEPARATOR_RE, UPPER_RE, LOWER_RE))
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, lost_lines long, lost_chars long, clean_text string"


def n_word_chars(s: str) -> int:
    return len(s) - sum(map(s.count, SPACES))


def line_fails(line: str, n_words: int, chars: int) -> bool:
    """Whether a line with n_words > 0 words and so many word characters goes."""
    bare = line.rstrip(SPACES)
    if not (_END.search(bare) or n_words >= 10 and _INSIDE.search(bare)):
        return True
    seps = len(_SEPARATOR.findall(bare))
    if seps >= 2 and 4 * seps >= n_words:
        return True
    if 100 * sum(map(bare.count, SYMBOLS)) > 10 * chars:
        return True
    if n_words >= 3 and (up := len(_UPPER.findall(bare))) * 10 > len(bare) and 100 * up > 70 * (up + len(_LOWER.findall(bare))):
        return True
    return n_words <= 25 and _PHRASES.search(bare.translate(_ASCII_LOWER)) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def judged(text: str | None, max_lost_percent: int) -> tuple:
    """All columns of SCHEMA but doc_id."""
    text = text or ""
    words, chars = text.encode("utf-8", "replace").split(), n_word_chars(text)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    seen, dups, lines, lost, lost_chars, clean = set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        if not (n := len(line.encode("utf-8", "replace").split())):
            clean.append(line)
            continue
        lines += 1
        dups += line in seen
        seen.add(line)
        here = n_word_chars(line)
        if line_fails(line, n, here):
            lost += 1
            lost_chars += here
        else:
            clean.append(line)
    kept = not failed and 100 * lost_chars <= max_lost_percent * chars
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, lines, lost, lost_chars, "\n".join(clean)


def _judge(max_lost_percent: int, with_text: bool):
    def rows(batch: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in batch:
            *found, clean = judged(text, max_lost_percent)
            yield doc_id, *found, clean if with_text else None

    return rows


def line_quality(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT, with_text: bool = True) -> DataFrame:
    """One row per document: the base figures, the verdict, what the line rules removed, and the text without it.

    Only doc_id and text are read. A null text counts as empty; a null doc_id
    stays null; repeated rows are judged each; a very long text is judged whole. An empty table gives no rows. One pass, no shuffle.
    """
    return map_rows(texts_of(docs), _judge, SCHEMA, max_lost_percent, with_text)


def keep_clean(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents that pass, with the columns of docs; text is without the lines that failed, and n_chars follows it.

    The cleaned text comes from an Arrow UDF, run once a row, under a name that docs doesn't have. Null and empty texts fail; repeated rows are
    judged each; a very long text is judged whole; an empty table gives no rows. Of names that differ only in case the lower-case one counts.
    """
    names, docs = docs.columns, exact(docs)
    clean = fresh(docs, "clean_text")

    def cleaned(text: str | None) -> str | None:
        found = judged(text, max_lost_percent)
        return found[10] if found[6] else None

    @F.pandas_udf("string")
    def cleaner(texts):
        made = texts.map(lambda t: cleaned(t if isinstance(t, str) else None))
        give_back()
        return made

    out = docs.withColumn(clean, cleaner.asNondeterministic()(F.col("text").cast("string"))).where(F.col(clean).isNotNull())
    out = out.withColumn("text", F.col(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).toDF(*names)
