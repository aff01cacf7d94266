"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text: its measurement is stored,
and bit k of ``failed`` says that rule k failed at its threshold.  A policy is
a version, a mask of the bits that reject and thus an AND; ablations count,
for each rule, what it alone rejects - sums of bit operations over the ledger,
never over texts.

Bit 0 and 1 are the base rules (too few words; repeated 3-word windows).
Defined results: null and empty texts have no words and fail bit 0; equal rows
give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ship_package, without, written

WS = " \t\n\x0b\x0c\r"
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_chars long, n_upper long, n_letters long"
MIN_WORDS = 50

#: name, SQL condition of failure over the measurements; the position is the bit.  Fixed once published: new rules go to the end.
RULES = [
    ("too_few_words", f"n_words < {MIN_WORDS}"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("mean_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("mostly_capitals", "10 * n_upper > 5 * n_letters"),
    ("few_letters", "10 * n_letters < 5 * word_chars"),
]
BASE_MASK = 0b11
#: Policy versions: which bits reject.
POLICIES = {1: BASE_MASK, 2: (1 << len(RULES)) - 1}
CURRENT_POLICY = 2


def measure(text: str | None) -> tuple[int, ...]:
    """All measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
    n = len(words)
    chars = len(text)
    word_chars = chars - sum(map(text.count, WS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WS)]
    letters = sum(map(text.count, _present(text, str.isalpha)))
    upper = sum(map(text.count, _present(text, str.isupper)))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated(words), len(lines), chars, upper, letters


def _present(text: str, kind) -> list[str]:
    return [c for c in set(text) if kind(c)]


def repeated(words: list) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    u = len(number)
    if u < 2_000_000:  # the product of three fits in 63 bits
        key = (ids[:-2] * u + ids[1:-1]) * u + ids[2:]
    else:
        pair = np.unique(ids[:-1] * u + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * np.int64(u) + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def _measure(batches):
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in batches:
        got = [measure(t.as_py()) for t in batch["text"]]
        cols = list(zip(*got)) or [[]] * len(names)
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *(pa.array(c, pa.int64()) for c in cols)], names=[*own, *names])


def with_failures(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the key of rows that have one, the measurements, and ``failed``: one bit a rule."""
    ship_package(docs.sparkSession)
    key = [ROW] if ROW in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    return with_failures(rows.mapInArrow(_measure, "doc_id long, " + "".join(c + " binary, " for c in key) + MEASURES))


def apply_policy(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """base_failed and kept under a policy version."""
    base, mask = (F.col("failed").bitwiseAND(F.lit(m).cast("long")) for m in (BASE_MASK, POLICIES[version] | BASE_MASK))
    return book.withColumn("base_failed", base != 0).withColumn("kept", mask == 0)


def ablation(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Per rule of a policy: rows it fails, rows it alone rejects, rows kept without it."""
    mask = POLICIES[version] | BASE_MASK
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    one = book.select(hit.alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))  # at most one row a combination of bits
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(name).alias("rule")) for k, (name, _) in enumerate(RULES) if mask >> k & 1))).alias("r")
    own = F.expr("shiftleft(1L, r.bit)")
    return (
        one.select("hit", "n", rules)
        .groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hit").bitwiseAND(own) != 0, F.col("n")).otherwise(0)).alias("failed_rows"),
            F.sum(F.when(F.col("hit") == own, F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.sum(F.when((F.col("hit") == 0) | (F.col("hit") == own), F.col("n")).otherwise(0)).alias("kept_without_it"),
        )
    )


def quality_report(docs: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    return apply_policy(ledger(docs), version).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of all rows, kept in the shared folder; policies and ablations read it without the texts."""
    return written(ledger(docs), "ledger")


def keep_good(docs: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The documents that a policy keeps by the stored ledger, with their own columns."""
    return without(docs, lambda rows: apply_policy(stored_ledger(rows), version).where("not kept").select(F.col(ROW).alias("__gone")))
