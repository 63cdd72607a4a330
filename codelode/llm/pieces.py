"""Cutting oversized items into overlapping pieces at natural boundaries, in SQL expressions only.

A bounded-quantifier pattern consumes the text from left to right. Its alternatives are ordered
by the strength of the boundary they end at: before a definition, after a line end, and only
where neither exists within the limit anywhere. The look-back for the overlap is computed from
the piece before, so a text of any length stays one row until the final explode: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200

#: Words that open a definition at the start of a line, after optional modifiers.
MODIFIERS = "export|default|public|private|protected|static|final|abstract|async|pub|unsafe|extern|inline|const"
OPENERS = "def|class|function|func|fn|impl|trait|struct|enum|interface|type|mod|module|package|CREATE|INSERT|UPDATE|SELECT|ALTER|DELETE"
DEFINITION = rf"(?=[ \t]{{0,4}}(?:(?:{MODIFIERS})[ \t]+)*(?:(?:{OPENERS})\b|@\w|#\[|/\*\*|///|\[\w|#{{1,6}} ))"


def pattern(first: int, later: int) -> str:
    """The extraction pattern: at most ``first`` code points at the start, ``later`` after that.

    A definition boundary is taken only from half of the limit on, so that pieces don't become
    tiny; a line end anywhere within the limit comes before a cut inside a line; a cut inside a
    line never parts a carriage return from its line feed unless nothing else is left.
    """

    def steps(n: int) -> str:
        low = max(1, n // 2)
        return "|".join(
            [
                rf".{{1,{n}}}\z",
                rf".{{{low},{n}}}(?<=\n){DEFINITION}",
                rf".{{1,{n}}}(?<=\n)",
                rf".{{1,{n}}}(?<!\r)",
                rf".{{1,{n}}}",
            ]
        )

    return rf"(?s)\A(?:{steps(first)})|(?:{steps(later)})"


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def split_pieces(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    start_col: str = "start_line",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    keep_small: bool = True,
) -> DataFrame:
    """Pieces ``(id, piece_no, n_pieces, content, overlap_chars, start_line, end_line)``.

    Every piece has at most ``limit`` code points. Each after the first begins with the last
    ``overlap`` or fewer characters of the one before: the overlap is moved forward to a line
    start where those characters hold one, else it is exactly ``overlap`` characters. Lines are
    1-based and inclusive and count ``\\n``; a null ``start_col`` counts as a null base and gives
    null lines. A text within the limit is one piece (left out with ``keep_small=False``); a null
    text gives no row, an empty one a single empty piece. ``overlap`` must be under ``limit``;
    with overlap 0 the pieces concatenate to the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    t = F.col("__t")
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(start_col).cast("int").alias("__s")).where(t.isNotNull())
    if not keep_small:
        src = src.where(F.length(t) > limit)
    bodies = F.when(F.length(t) <= limit, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(pattern(limit, limit - overlap)), F.lit(0)))
    src = src.withColumn("__p", bodies)

    def tail(i: Column) -> Column:
        raw = F.right(F.element_at(F.col("__p"), i), F.lit(overlap))
        snapped = F.regexp_replace(raw, r"(?s)\A[^\n]*\n(?=.)", "")
        return F.when(F.lit(overlap == 0), F.lit("")).otherwise(snapped)

    src = src.withColumn("__o", F.transform(F.sequence(F.lit(1), F.size("__p")), lambda i: F.when(i == 1, F.lit("")).otherwise(tail(F.greatest(i - 1, F.lit(1))))))
    counts = F.transform(F.col("__p"), _newlines)
    before = F.aggregate(
        counts,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")),
        lambda a, c: F.struct((a["n"] + c).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")),
        lambda a: a["out"],
    )
    src = src.withColumn("__n", before)
    out = src.select("__id", "__s", F.size("__p").alias("__k"), F.posexplode(F.arrays_zip(F.col("__p").alias("p"), F.col("__o").alias("o"), F.col("__n").alias("n"))).alias("piece_no", "__z"))
    body, over, seen = F.col("__z.p"), F.col("__z.o"), F.col("__z.n")
    # a line end that closes the whole text is followed by an empty last line, as in the chunk's own end
    ends_line = F.when(F.endswith(body, F.lit("\n")) & (F.col("piece_no") + 1 < F.col("__k")), 1).otherwise(0)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("piece_no"),
        F.col("__k").alias("n_pieces"),
        F.concat(over, body).alias("content"),
        F.length(over).alias("overlap_chars"),
        (F.col("__s") + seen - _newlines(over)).cast("int").alias("start_line"),
        (F.col("__s") + seen + _newlines(body) - ends_line).cast("int").alias("end_line"),
    )

