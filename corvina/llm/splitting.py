"""Cuts texts above a token limit into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.tokens import DEFAULT_TOKENIZER, byte_shapes, encoder

#: Cutting may give the tokens next to a cut another shape; so many are kept free in each piece.
SLACK = 8


def _in(values: np.ndarray, characters: str) -> np.ndarray:
    return np.isin(values, np.array([ord(c) for c in characters], dtype=values.dtype))


def skeleton(text: str, tokens: np.ndarray, path: str) -> tuple[str, np.ndarray]:
    """One letter per token for the boundary after it, and the number of characters up to there.

    P: end of a paragraph, L: of a line, S: of a sentence, C: of a clause, W: of a word, x: inside a word,
    z: inside a character, where no cut is possible.
    """
    begins, inside = byte_shapes(path)
    ends = np.cumsum(begins[tokens])
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    padded = np.concatenate([np.array([10, 10], np.uint32), chars, np.array([10, 10], np.uint32)])
    before2, before, after, after2 = padded[ends], padded[ends + 1], padded[ends + 2], padded[ends + 3]
    blank = _in(after, " \t\r\n  ")
    stop = _in(before, ".!?…") | (_in(before, "\"'»”’)]") & _in(before2, ".!?…"))
    known, where = np.unique(after2, return_inverse=True)  # an abbreviation is followed by a small letter or a number
    opens = np.array([not (chr(c).islower() or chr(c).isdigit()) for c in known])[where]
    marks = np.select(
        [
            np.append(inside[tokens[1:]], False),
            (before == 10) & (before2 == 10),
            before == 10,
            stop & blank & opens,
            _in(before, ",;:") & blank,
            blank | _in(before, " \t\r  "),
        ],
        [ord(c) for c in "zPLSCW"],
        default=ord("x"),
    ).astype(np.uint8)
    return marks.tobytes().decode("ascii"), ends


def cutting_pattern(first: int, rest: int) -> str:
    """Alternatives by falling strength of the boundary, each with bounded length; the last one cuts anywhere.

    What fits is taken whole. A boundary counts if the piece has at least half the allowed length, or a quarter for
    the weaker ones, so that a strong boundary near the start does not leave a tiny piece.
    """

    def ways(most: int, start: str) -> list[str]:
        half, quarter = most // 2, most // 4
        return (
            [f"{start}.{{1,{most}}}$"]
            + [f"{start}.{{{half},{most - 1}}}{c}" for c in ("P", "[PL]", "[PLS]")]
            + [f"{start}.{{{quarter},{most - 1}}}{c}" for c in ("[PLS]", "[PLSC]", "[PLSCW]")]
            + [f"{start}.{{0,{most - 1}}}[^z]"]
        )

    return "|".join(ways(first, "^") + ways(rest, ""))


def split_oversized(
    df: DataFrame,
    id_column: str = "id",
    text_column: str = "content",
    limit: int = 1200,
    overlap: int = 100,
    tokenizer: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """Pieces of every text with more than ``limit`` tokens, in order.

    Result: id, piece_no (from 1), n_pieces, start_char (from 0), overlap_chars, n_tokens, piece. The first
    ``overlap_chars`` characters of a piece repeat the end of the one before; without them the pieces of an id,
    joined in order, are the text. No piece has more than ``limit`` tokens.

    A token is at least one byte, so texts of up to ``limit`` bytes are left out before tokenizing. The rest become
    a string with one letter per token, cut by one regular expression; positions and overlaps are array functions.

    Edge cases: null and empty texts, and those within the limit, give no rows; texts without any blank are cut
    between characters; rows delivered twice (same id) count once; extra columns are ignored.
    """
    if not 0 <= overlap < limit - SLACK - 8:
        raise ValueError("the overlap must be well below the limit")
    rest = limit - overlap - SLACK

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["_text"], strict=True):
                tokens = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
                if len(tokens) > limit:
                    rows.append((key, text, *skeleton(text, tokens, tokenizer)))
            yield pd.DataFrame(rows, columns=["id", "_text", "_shape", "_ends"])

    key_type = df.schema[id_column].dataType.simpleString()
    large = (
        df.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
        .where(F.octet_length("_text") > limit)
        .mapInPandas(shapes, f"id {key_type}, _text string, _shape string, _ends array<int>")
        .dropDuplicates(["id"])  # after the size is known, as few texts are that large
    )
    cuts = large.withColumn(
        "_lengths", F.transform(F.regexp_extract_all("_shape", F.lit(cutting_pattern(limit - SLACK, rest)), F.lit(0)), F.length)
    ).withColumn(
        "_stops",  # tokens up to the end of each piece
        F.aggregate(
            "_lengths",
            F.array().cast("array<int>"),
            lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)),
        ),
    )
    pieces = cuts.select(
        "id", "_text", "_shape", "_ends",
        F.size("_stops").alias("n_pieces"),
        F.posexplode(F.arrays_zip(F.col("_stops").alias("stop"), F.col("_lengths").alias("n"))).alias("_i", "_p"),
    ).withColumn("_stop", F.col("_p.stop")).withColumn("_body", F.col("_p.stop") - F.col("_p.n"))
    # The overlap begins at the first end of a word among the places just inside the lookback, else at any whole character.
    look = F.substring(F.col("_shape"), F.col("_body") - overlap, F.lit(max(1, overlap // 2)))
    back = F.when(F.col("_i") == 0, 0).otherwise(
        F.col("_body")
        - overlap
        - 1
        + F.coalesce(
            F.nullif(F.regexp_instr(look, F.lit("[PLSCW]")), F.lit(0)), F.nullif(F.regexp_instr(look, F.lit("[^z]")), F.lit(0)), F.lit(overlap + 1)
        )
    )

    def chars(tokens):
        return F.when(tokens <= 0, 0).otherwise(F.element_at("_ends", F.greatest(tokens, F.lit(1))))

    pieces = pieces.withColumn("_from", (back if overlap else F.col("_body")).cast("int"))
    return pieces.select(
        "id",
        (F.col("_i") + 1).alias("piece_no"),
        "n_pieces",
        chars(F.col("_from")).alias("start_char"),
        (chars(F.col("_body")) - chars(F.col("_from"))).alias("overlap_chars"),
        (F.col("_stop") - F.col("_from")).alias("n_tokens"),
        F.substring("_text", chars(F.col("_from")) + 1, chars(F.col("_stop")) - chars(F.col("_from"))).alias("piece"),
    )
