"""Japanese financial answers as text: normalising, reading numbers, matching.

All functions take and return Columns. Everything but NFKC is a built-in expression, so it stays in generated code; NFKC has
no built-in form and is an Arrow function that is handed only the values beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerlark.ship import by_value

by_value(__name__)

# Units in the order in which they are taken off, and multipliers in the order in which they are looked for.
UNITS = ("百万円", "千円", "億円", "兆円", "円", "ドル", "ポイント", "pt", "bps")
MULTIPLIERS = (("千", 1_000), ("百万", 1_000_000), ("億", 100_000_000), ("兆", 1_000_000_000_000))
VALIDATOR_UNITS = ("%", "円", "百万円", "千円", "億円", "兆円", "倍", "ポイント")
CELL_UNITS = ("百万円", "千円", "億円", "兆円", "円", "ドル", "ポイント", "pt", "bps", "%")

BLANK = r"[\s\x1c-\x1f]"  # what counts as white space, with (?U)
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())  # the same as a set of characters
#: All units at the end of an answer, in the order in which taking them off one by one would find them.
UNITS_OFF = "".join(f"(?:{u})?" for u in reversed(UNITS)) + r"\z"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)\z"
#: Decimal digits of other scripts, which NFKC leaves alone, and their values.
OTHER_DIGITS = "".join(chr(c) for c in range(0x660, 0x10000) if unicodedata.category(chr(c)) == "Nd" and not 0xFF10 <= c <= 0xFF19)
DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc_arrow(values: pa.Array) -> pa.Array:
    """By the interpreter's tables: Arrow's own kernel takes characters apart and doesn't compose them again."""
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in values.to_pylist()], pa.string())


#: Forms of full width and the ideographic space, which NFKC makes ASCII; and what NFKC leaves alone and never joins with a
#: neighbour: accented letters of Latin-1, kana, ideographs and the marks that answers hold. Text of nothing else needs no trip to Python.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
PLAIN = "△▲\u00c0-\u00ff\u3001-\u3003\u3005-\u3015\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff"
#: One character beyond these and ASCII. Only where one is beyond ASCII its kind is looked up: the long list of ranges is slow.
BEYOND = rf"[^\x00-\x7F](?<![{FULL[0]}-{FULL[-2]}\u3000{PLAIN}])"


def nfkc(c: Column) -> Column:
    """Compatibility-composed text. Only values with characters beyond ASCII, FULL and PLAIN take the trip through Arrow, and only
    those with one of FULL are gone through character by character."""
    full = rf"{FULL[0]}-{FULL[-2]}\u3000"
    return F.coalesce(arrow_udf(nfkc_arrow, "string")(F.when(c.rlike(BEYOND), c)), F.when(c.rlike(f"[{full}]"), F.translate(c, FULL, NARROW)).otherwise(c))


def strip(c: Column) -> Column:
    """Without white space at both ends, ideographic spaces too (``trim`` alone knows only blanks)."""
    return F.btrim(c, F.lit(BLANKS))


def ends_off(c: Column, suffix: str) -> Column:
    """The suffix (a plain word) taken off once, if it is there. One reference to ``c``: chains of these stay small."""
    return F.regexp_replace(c, rf"{suffix}\z", "")


def to_double(c: Column) -> Column:
    """The number that the whole text writes in digits, sign and point; else null (the cast alone would take 1e5 or 5d)."""
    return F.regexp_extract(c, NUMBER, 0).try_cast("double")


def _digits_only(c: Column) -> Column:
    return to_double(F.translate(F.regexp_replace(c, r"[^\p{Nd}.\-+]", ""), OTHER_DIGITS, DIGIT_VALUES))


def normalize_answer(c: Column | str) -> Column:
    """Comparable form of an answer (null: empty): stripped, NFKC, a leading triangle as minus, commas between digits and
    the verb endings しました and した taken off, lower case."""
    s = nfkc(strip(F.coalesce(col(c), F.lit(""))))
    s = F.regexp_replace(s, "^[△▲]", "-")
    s = F.regexp_replace(s, r"(?<=\p{Nd}),(?=\p{Nd})", "")
    return strip(F.lower(ends_off(s, "(?:しました|した)")))


def number_of(normal: Column) -> Column:
    """The number of a normalised answer, or null. Units go one by one, each at most once; then the first multiplier that
    occurs decides; a percent sign is dropped without scaling."""
    s = F.regexp_replace(normal, UNITS_OFF, "")
    factor = F.coalesce(*(F.when(F.contains(s, F.lit(sign)), float(by)) for sign, by in MULTIPLIERS), F.lit(1.0))
    return _digits_only(s) * factor  # what isn't digit, sign or point goes, the multiplier and the percent sign too


def extract_number(c: Column | str) -> Column:
    return number_of(normalize_answer(c))


def exact_match(predicted: Column | str, gold: Column | str) -> Column:
    return normalize_answer(predicted) == normalize_answer(gold)


def match_numbers(p: Column, g: Column, x: Column, y: Column, tolerance: float = 0.01) -> Column:
    """``numerical_match`` of two normalised answers and their numbers."""
    by_value = F.when(y == 0, x == 0).otherwise(F.abs(x - y) / F.abs(y) <= tolerance)
    return F.when(x.isNull() | y.isNull(), p == g).otherwise(by_value)


def match_normal(p: Column, g: Column, tolerance: float = 0.01) -> Column:
    """``numerical_match`` of two normalised answers."""
    return match_numbers(p, g, number_of(p), number_of(g), tolerance)


def numerical_match(predicted: Column | str, gold: Column | str, tolerance: float = 0.01) -> Column:
    """Equal within a relative tolerance (inclusive); exact where either has no number; 0 only matches 0."""
    return match_normal(normalize_answer(predicted), normalize_answer(gold), tolerance)


def _last_line(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    return F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))


def harness_answer(c: Column | str) -> Column:
    """The answer in a model's output: after the first label, else the last line that isn't blank, else empty."""
    s = F.coalesce(col(c), F.lit(""))
    label = rf"(?dU)(?:Answer|answer|A|回答){BLANK}*[:：]{BLANK}*(.+)"
    return F.when(s.rlike(label), strip(F.regexp_extract(s, label, 1))).otherwise(_last_line(s))


def tagged_answer(c: Column | str) -> Column:
    """``struct(predicted, parsed)``: the text after ``Answer:`` in any case, else the last line with parsed false."""
    s = F.coalesce(col(c), F.lit(""))
    label = rf"(?diU)Answer:{BLANK}*([^\n]+?)(?:\n|$)"
    has = s.rlike(label)
    return F.struct(F.when(has, strip(F.regexp_extract(s, label, 1))).otherwise(_last_line(s)).alias("predicted"), has.alias("parsed"))


def harness_score(response: Column | str, gold: Column | str) -> Column:
    """``struct(exact_match, numerical_match)`` as 1.0 or 0.0 of a model's output (null: empty)."""
    p, g = normalize_answer(harness_answer(response)), normalize_answer(gold)
    return F.struct((p == g).cast("double").alias("exact_match"), match_normal(p, g).cast("double").alias("numerical_match"))


def with_harness_score(rows: DataFrame, response: str, gold: str, exact: str = "exact_match", numerical: str = "numerical_match") -> DataFrame:
    """``rows`` with the two scores of ``harness_score`` as columns, added in steps, so that each text is normalised and read once."""
    own = rows.withColumns({"hs__a": harness_answer(response)})
    own = own.withColumns({"hs__p": normalize_answer("hs__a"), "hs__g": normalize_answer(gold)})
    own = own.withColumns({"hs__x": number_of(F.col("hs__p")), "hs__y": number_of(F.col("hs__g"))})
    p, g = F.col("hs__p"), F.col("hs__g")
    own = own.withColumns({exact: (p == g).cast("double"), numerical: match_numbers(p, g, F.col("hs__x"), F.col("hs__y")).cast("double")})
    return own.drop("hs__a", "hs__p", "hs__g", "hs__x", "hs__y")


def validator_normalize(c: Column | str) -> Column:
    """The validator's form: every triangle is a minus, every comma goes."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(strip(col(c))), ",+", ""), "[△▲]", "-"))


def validator_number(c: Column | str) -> Column:
    """The first number after the validator's units are taken out wherever they stand."""
    s = validator_normalize(c)
    for unit in VALIDATOR_UNITS:
        s = F.replace(s, F.lit(unit), F.lit(""))
    found = F.regexp_extract(s, r"(?U)-?\d+\.?\d*", 0)
    return to_double(F.translate(found, OTHER_DIGITS, DIGIT_VALUES))


def validator_match(predicted: Column | str, gold: Column | str, tolerance: float = 0.05) -> Column:
    x, y = validator_number(predicted), validator_number(gold)
    by_value = F.when(y == 0, F.abs(x) < 0.001).otherwise(F.abs(x - y) / F.abs(y) <= tolerance)
    return F.when(x.isNull() | y.isNull(), validator_normalize(predicted) == validator_normalize(gold)).otherwise(by_value)


def audit_number(c: Column | str) -> Column:
    return to_double(F.replace(F.regexp_extract(col(c), r"-?[\d,]+\.?\d*", 0), F.lit(","), F.lit("")))


def decimals_of(c: Column | str) -> Column:
    return F.char_length(F.regexp_extract(col(c), r"-?[\d,]+\.(\d+)", 1))


def with_audit_match(rows: DataFrame, predicted: str, gold: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``numerical_match``, or equal after rounding (half to even) to the decimals that gold shows.

    Added in steps, so that each text is normalised and read once.
    """
    own = rows.withColumns({"am__p": normalize_answer(predicted), "am__g": normalize_answer(gold), "am__a": audit_number(predicted), "am__b": audit_number(gold), "am__d": decimals_of(gold)})
    own = own.withColumns({"am__x": number_of(F.col("am__p")), "am__y": number_of(F.col("am__g"))})
    p, g, d = F.col("am__a"), F.col("am__b"), F.col("am__d")
    rounded = F.when(d < 13, F.replace(F.call_function("format_number", p, d), F.lit(","), F.lit("")).try_cast("double")).otherwise(p)
    close = F.coalesce(F.abs(rounded - g) < F.lit(0.5) * F.pow(F.lit(10.0), -d) + 1e-9, F.lit(False))
    alike = match_numbers(F.col("am__p"), F.col("am__g"), F.col("am__x"), F.col("am__y"))
    return own.withColumn(out, alike | close).drop("am__p", "am__g", "am__a", "am__b", "am__d", "am__x", "am__y")


def cell_number(c: Column | str) -> Column:
    """A table cell's number: a triangle is a minus, commas and blanks go, each unit is taken off once at the end. Full-width digits and those of other scripts count as digits."""
    s = strip(col(c))
    negative = s.rlike("^[△▲]")
    s = F.regexp_replace(F.regexp_replace(s, "^[△▲]", ""), "[, ]", "")
    for unit in CELL_UNITS:
        s = ends_off(s, unit)
    s = F.translate(s, "０１２３４５６７８９" + OTHER_DIGITS, "0123456789" + DIGIT_VALUES)
    value = F.regexp_extract(strip(s), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def near(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Equal, within the relative tolerance, or within 0.5."""
    return (a == b) | F.when(b == 0, F.abs(a) <= 0.5).otherwise((F.abs(a - b) / F.abs(b) <= tolerance) | (F.abs(a - b) <= 0.5))
