"""Line-first cleaning: rules judge each line, failing lines go, and a document
that loses too much of its text is rejected.

A line fails by its

* punctuation: words of marks alone, words with symbols, shouting, stutter, or a
  short line that trails off in an ellipsis;
* navigation: separators between its words, or a run of short lines that end
  without any mark, as a menu with an item a line is;
* boilerplate: a short line that holds a notice's phrase, sign, address or braces,
  or that the text repeats again and again.

Defined cases: a NULL or empty text has one empty line and no words and fails the
base rules; blank lines are never judged, stay, and don't end a run; repeated rows
are judged alike and stay repeated; an empty table gives an empty result; columns
may have any names.  Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.scratch import small_batches

SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = SYMBOLS.encode()
#: Tokens that separate the items of a menu or a breadcrumb.
SEPARATORS = frozenset(x.encode() for x in ("|", ">", "»", "·", "•", "/", "::"))
#: What ends a line that says something.  Commas and colons count: verse and lists go on.
END_MARKS = tuple(x.encode() for x in (".", "!", "?", ",", ";", ":", ")", "]", '"', "'", "…", "”", "’", "»", "。", "！", "？"))
ELLIPSES = (b"...", "…".encode())
ASCII_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
#: Signs of page furniture in any language.
NOTICE_SIGNS = tuple(x.encode() for x in ("©", "®", "™", "{", "}", "http://", "https://", "www."))
#: Short lines that hold one of these are page furniture (fixed values: English, German, French, Spanish).
NOTICE_PHRASES = tuple(
    x.encode()
    for x in (
        "all rights reserved",
        "accept cookies",
        "cookie policy",
        "privacy policy",
        "terms of use",
        "terms of service",
        "enable javascript",
        "click here",
        "read more",
        "sign up",
        "subscribe to",
        "powered by",
        "alle rechte vorbehalten",
        "cookies akzeptieren",
        "datenschutzerklärung",
        "nutzungsbedingungen",
        "hier klicken",
        "weiterlesen",
        "newsletter abonnieren",
        "tous droits réservés",
        "accepter les cookies",
        "politique de confidentialité",
        "conditions d'utilisation",
        "cliquez ici",
        "lire la suite",
        "abonnez-vous",
        "todos los derechos reservados",
        "aceptar cookies",
        "política de privacidad",
        "condiciones de uso",
        "haga clic aquí",
        "leer más",
        "suscríbete",
    )
)
BOILERPLATE = NOTICE_SIGNS + NOTICE_PHRASES


@dataclass(frozen=True)
class Limits:
    """base_*: the fixed document rules; the rest: the line rules and the final verdict."""

    base_min_words: int = 50
    base_max_repeat_percent: int = 50
    separator_share: float = 0.15
    symbol_words_share: float = 0.3
    shout_share: float = 0.5
    shout_min_words: int = 3
    stutter_share: float = 0.5
    stutter_min_words: int = 6
    marks_share: float = 0.5
    item_max_words: int = 5
    run_lines: int = 5
    boilerplate_max_words: int = 12
    repeated_lines: int = 4
    max_lost_share: float = 0.3


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in ``words``."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = len(ids)
    pairs = codes[:-2] * base + codes[1:-1]
    if base > 2_000_000:  # base**3 would leave 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs * base + codes[2:], return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def line_fails(line: bytes, words: list[bytes], limits: Limits = Limits()) -> bool:
    """Whether a line with words fails by itself."""
    n = len(words)
    if sum(w in SEPARATORS for w in words) > limits.separator_share * n and n >= 3:
        return True
    if line.translate(None, SYMBOL_BYTES) != line:
        noisy = sum(w.translate(None, SYMBOL_BYTES) != w and w not in SEPARATORS for w in words)
        if noisy > limits.symbol_words_share * n:
            return True
    if line.translate(None, ASCII_MARKS) != line and sum(not w.translate(None, ASCII_MARKS) for w in words) > limits.marks_share * n:
        return True
    if n >= limits.shout_min_words and line.upper() != line.lower():
        if b"!!" in line and sum(w.endswith(b"!!") for w in words) > limits.shout_share * n:
            return True
        if sum(w.upper() == w != w.lower() for w in words) > limits.shout_share * n:
            return True
    if n >= limits.stutter_min_words and sum(map(bytes.__eq__, words, words[1:])) > limits.stutter_share * (n - 1):
        return True
    if n <= limits.boilerplate_max_words:
        low = line.lower()
        return words[-1].endswith(ELLIPSES) or any(x in low for x in BOILERPLATE)
    return False


def clean(data: bytes | None, limits: Limits = Limits()) -> tuple:
    """(n_words, n_dup_lines, n_repeat_words, lost_words, text of the lines that stay)."""
    lines = (data or b"").split(b"\n")
    split = [line.split() for line in lines]
    spoken = [i for i, words in enumerate(split) if words]
    times = Counter(lines[i] for i in spoken)
    fails: set[int] = set()
    run: list[int] = []
    for i in [*spoken, None]:
        if i is not None and len(split[i]) <= limits.item_max_words and not split[i][-1].endswith(END_MARKS):
            run.append(i)
            continue
        if len(run) >= limits.run_lines:
            fails.update(run)
        run = []
    for i in spoken:
        words = split[i]
        if i not in fails and ((len(words) <= limits.boilerplate_max_words and times[lines[i]] >= limits.repeated_lines) or line_fails(lines[i], words, limits)):
            fails.add(i)
    everything = [w for i in spoken for w in split[i]]
    lost = sum(len(split[i]) for i in fails)
    return len(everything), len(spoken) - len(times), repeated_words(everything), lost, b"\n".join(x for i, x in enumerate(lines) if i not in fails) if fails else (data or b"")


def _measure(limits: Limits, with_text: bool):
    """Arrow batches (id, text) to the id and the fields of :func:`clean`."""
    import pyarrow.compute as pc

    spaces = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

    def total(column, patterns):
        return sum(pc.count_substring(column, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in patterns)

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            rows = [clean(x, limits) for x in text.cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            n_chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            out = [
                batch.column(0),
                pa.array(cols[0], pa.int64()),
                pa.array(n_chars - total(text, spaces)),
                pa.array(total(text, SYMBOLS)),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array(cols[3], pa.int64()),
            ]
            if with_text:
                out.append(pa.array(cols[4], pa.binary()).cast(pa.string()))
            names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "cleaned"]
            yield pa.record_batch(out, names[: len(out)])

    return run


def measure(docs: DataFrame, carry: list[str], text_col: str = "text", limits: Limits = Limits(), with_text: bool = False) -> DataFrame:
    """A struct ``row`` of the columns ``carry`` and the measures, base_failed and kept."""
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    kind = T.StructType([docs.schema[c] for c in carry])
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]
    schema = T.StructType([T.StructField("row", kind), *(T.StructField(x, T.LongType()) for x in fields)])
    if with_text:
        schema.add("cleaned", T.StringType())
    found = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure(limits, with_text), schema)
    failed = (F.col("n_words") < limits.base_min_words) | (100 * F.col("n_repeat_words") > limits.base_max_repeat_percent * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= limits.max_lost_share * F.col("n_words")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Id, measures and verdict for every row."""
    found = measure(docs, [id_col], text_col, limits)
    return found.select(F.col("row")[id_col].alias(id_col), *found.columns[1:])


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns and their failing lines removed."""
    found = measure(docs, [c for c in docs.columns if c != text_col], text_col, limits, with_text=True).where("kept")
    return found.select(*[F.col("cleaned").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
