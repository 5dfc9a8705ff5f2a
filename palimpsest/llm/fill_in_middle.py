"""Fill-in-middle transformation: DuckDB inside mapInArrow. Each batch is a table to it, and SQL on lists of code points cuts, marks
and rebuilds the texts; Python sees batches, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import packed
from palimpsest.llm.files import sized_slices

#: Bytes of text that DuckDB gets at once, beside the text that exceeds it by itself: lists of code points take 16 bytes each.
SLICE_BYTES = 2 << 20

_SQL = """
WITH h AS (
  SELECT id, coalesce(t, '') AS t, regexp_extract_all(coalesce(t, ''), '(?s).') AS u, sha256($seed || ':' || coalesce(id, '')) AS x FROM batch),
k AS (
  SELECT t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CAST('0x' || x[17:24] AS BIGINT) % 100 AS p3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS p4 FROM h),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, $p) OR contains(t, $s) OR contains(t, $m) OR p3 >= $cut THEN 'plain'
              WHEN p4 < $spm THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (
  SELECT t, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
         CASE form WHEN 'plain' THEN t
           WHEN 'psm' THEN $p || array_to_string(list_slice(u, 1, a), '') || $s || array_to_string(list_slice(u, b + 1, n), '')
                        || $m || array_to_string(list_slice(u, a + 1, b), '')
           ELSE $s || array_to_string(list_slice(u, b + 1, n), '') || $p || array_to_string(list_slice(u, 1, a), '')
                        || $m || array_to_string(list_slice(u, a + 1, b), '') END AS output FROM f),
-- back from the output and its form alone: the marks occur nowhere else in it
v AS (SELECT *, CASE WHEN form <> 'plain' THEN regexp_split_to_array(output, $marks) END AS q FROM o)
SELECT n, form, prefix_chars, middle_chars, output,
       CASE form WHEN 'plain' THEN output WHEN 'psm' THEN q[2] || q[4] || q[3] ELSE q[3] || q[4] || q[2] END AS restored
FROM v
"""


def fill_in_middle(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """The columns of docs in a struct `row`, and n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain), output, and restored, which is rebuilt from output and form.

    Cuts and forms follow from the SHA-256 of seed, a colon and the decimal id, so they depend on nothing else. A null text is the
    empty text, which is plain, as is one that holds a mark; a null id counts as the empty string. Texts of any length are cut whole:
    a batch is handed on in slices of bounded size, a longer text by itself. Rows that repeat give equal rows; an empty table
    gives none; columns of docs may have any name. The three marks must be of the form <letter>, so none can arise across an edge.
    """
    if len(set(marks)) != 3 or any(len(x) != 3 or x[0] != "<" or x[2] != ">" or not x[1].isalpha() for x in marks):
        raise ValueError("marks must be three different strings of the form <letter>")
    p, s, m = marks
    given = {"seed": seed, "p": p, "s": s, "m": m, "cut": fim_percent, "spm": spm_percent, "marks": f"<[{p[1]}{s[1]}{m[1]}]>"}
    own = packed(docs, id=docs[f"`{doc_id}`"].cast("string"), t=docs[f"`{text}`"])
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([own.schema["row"]])
    for name, kind in (("n", long), ("form", string), ("prefix_chars", long), ("middle_chars", long), ("output", string), ("restored", string)):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for whole in batches:
                for batch in sized_slices(whole, "t", SLICE_BYTES):
                    db.register("batch", pa.Table.from_batches([batch.select(["id", "t"])]))
                    made = db.sql(_SQL, params=given).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    columns = [batch.column("row"), *(_whole(c) for c in made.columns)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", *made.column_names])

    return own.mapInArrow(cut, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
