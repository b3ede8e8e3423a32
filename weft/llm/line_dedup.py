"""Line dedup by winnowing over line hashes.

A document is the sequence of its non-blank lines. From every window of
`run - gram + 1` line-gram hashes the minimum is a fingerprint, so two places
that share a run of at least `run` lines are sure to share a fingerprint at the same
place of that run. Fingerprints that occur once are dropped; at the places of the others, matches
are extended both ways: each window of `run` lines around the fingerprint is compared by a
128-bit hash with the earliest place that has the same lines, and
overlapping matched windows make up the maximal run. All but the earliest
copy are deleted. A single long line is a run of its own beside these.

Places are grouped by aggregates with map-side combine and never listed pair by pair, so
a line that a third of all documents share costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import NO_ID, Scratch, plain, row_key

BLANKS = " \t\r\x0b\x0c"
UNROLLED = 6  # lines of a run whose windows are written out, which is quicker than slices of arrays


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, gram: int = 1, long_words: int | None = 51) -> DataFrame:
    """The input rows with columns n_lines, n_removed, kept_text and all_removed (has it lost all of its non-blank lines?) added.

    A line is deleted if it lies in a run of `run` consecutive non-blank lines that also
    starts at an earlier place, by (id, line number); lines are compared without the white space
    around them. A document of fewer non-blank lines counts as one run and is compared with other such
    documents. A line of at least `long_words` words is also deleted wherever it stands, in documents of
    any number of lines, if it stands at an earlier place too (None: no such rule). Blank lines are never deleted, except that a document left with no other lines is empty.
    Nulls: a null text has one blank line and stays null; null ids come after all ids, together with the largest long; rows of equal
    id (repeated rows) aren't earlier than each other. All other columns are kept as they are, whatever their names;
    existing columns of the added ones' names are replaced. An empty table gives an empty result.
    """
    if not 1 <= gram <= run:
        raise ValueError("needs 1 <= gram <= run")
    if long_words is not None and long_words < 1:
        raise ValueError("needs long_words >= 1")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.drop("n_lines", "n_removed", "kept_text", "all_removed")
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
    # k_row tells apart rows of one id
    base = plain(docs).withColumns({"k_id": F.coalesce(F.col(f"c{docs.columns.index(id_col)}").cast("long"), F.lit(int(NO_ID))), "k_row": row_key(text)})
    solid = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("s"))), lambda y: y.s != "")
    lines = base.select("k_id", "k_row", solid.alias("y")).where("size(y) > 0")
    many = lambda z: (F.length(z.s) >= 2 * long_words - 1) & F.rlike(z.s, F.lit(f"^(?:[^{BLANKS}]++[{BLANKS}]++){{{long_words - 1}}}"))
    mark = [F.transform("y", many).alias("m")] if long_words else []
    lines = lines.select("k_id", "k_row", F.expr("transform(y, z -> z.i)").alias("at"), F.transform("y", lambda z: F.xxhash64(z.s)).alias("h"), F.transform("y", lambda z: F.xxhash64(F.lit(7), z.s)).alias("g"), *mark)
    lines = lines.withColumn("n", F.size("h"))
    grams = F.expr("h" if gram == 1 else f"case when n < {gram} then h else transform(sequence(0, n - {gram}), j -> xxhash64(slice(h, j + 1, {gram}))) end")
    width = run - gram + 1
    if run <= UNROLLED:
        every = lambda name, n: ", ".join(f"{name}[j + {o}]" for o in range(n))
        least = f"least({every('k', width)})" if width > 1 else "k[j]"
        place = "".join(f" when k[j + {o}] = {least} then j + {o}" for o in range(width - 1, 0, -1))
        place = f"case{place} else j end" if place else "j"
        window = f"transform(sequence(0, n - {run}), j -> struct({least} as f, {place} as p, xxhash64({every('h', run)}) as a, xxhash64(7, {every('g', run)}) as b, array({every('at', run)}) as at))"
    else:
        window = f"""transform(sequence(0, n - {run}), j -> struct(
            array_min(slice(k, j + 1, {width})) as f,
            j + cast({width} - array_position(reverse(slice(k, j + 1, {width})), array_min(slice(k, j + 1, {width}))) as int) as p,
            xxhash64(slice(h, j + 1, {run})) as a, xxhash64(7, slice(g, j + 1, {run})) as b, slice(at, j + 1, {run}) as at))"""
    short = "array(struct(xxhash64(n, h) as f, 0 as p, xxhash64(n, h) as a, xxhash64(7, n, g) as b, at as at))"
    found = f"case when n >= {run} then {window} else {short} end"
    if long_words:
        found = f"concat({found}, transform(filter(sequence(0, n - 1), j -> m[j]), j -> struct(xxhash64(11, h[j]) as f, j as p, xxhash64(11, h[j]) as a, xxhash64(7, 11, g[j]) as b, array(at[j]) as at)))"
    found = lines.withColumn("k", grams).select("k_id", "k_row", "n", F.explode(F.expr(found)).alias("w"))
    windows = scratch.cut(found.select("k_id", "k_row", "n", "w.*"), "windows")
    places = windows.select("k_id", "k_row", "p", "f").distinct()
    again = places.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f")
    near = windows.join(again, "f", "left_semi")
    firsts = near.groupBy("a", "b").agg(F.min(F.struct("k_id", F.expr("at[0]").alias("i"))).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    late = near.join(firsts, ["a", "b"]).where("struct(k_id, at[0]) > first")
    gone = scratch.cut(late.select("k_id", "k_row", "n", F.explode("at").alias("i")).groupBy("k_id", "k_row").agg(F.collect_set("i").alias("gone"), F.max("n").alias("n")), "gone")
    scratch.keep(gone)
    # texts are split again after the join, so that they move once and whole, and only those that lose lines
    done = base.join(gone.hint("shuffle_hash"), ["k_id", "k_row"], "left").withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
    done = done.withColumn("k_lines", F.when(F.col("n_removed") > 0, F.split(text, "\n", -1)))
    left = F.expr("array_join(transform(array_except(sequence(0, size(k_lines) - 1), gone), i -> k_lines[i]), '\n')")
    kept = F.when(F.col("n_removed") == 0, text).when(F.col("n_removed") == F.col("n"), F.lit("")).otherwise(left)
    n_lines = F.coalesce(F.when(F.col("k_lines").isNotNull(), F.size("k_lines").cast("long")), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    all_gone = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n"))
    return done.select(*[f"c{i}" for i in range(len(docs.columns))], n_lines, "n_removed", kept, F.coalesce(all_gone, F.lit(False))).toDF(*docs.columns, "n_lines", "n_removed", "kept_text", "all_removed")


SQL = r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
solid as (select doc_id, i, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as s from lines where trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
runs as (select doc_id, i, s, lead(i) over w as i2, lead(s) over w as s2, count(*) over (partition by doc_id) as n from solid window w as (partition by doc_id order by i)),
keys as (select doc_id, i, i2, n > 1 as two, s || case when n > 1 then chr(10) || s2 else '' end as k from runs where n = 1 or s2 is not null),
late as (select * from (select *, min((doc_id, i)) over (partition by two, k) as f from keys) where (doc_id, i) > f),
alone as (select doc_id, i, min((doc_id, i)) over (partition by s) as f from solid where length(s) > 100 and len(string_split_regex(s, '[\x20\x09\x0D\x0B\x0C]+')) >= 51),
gone as (select doc_id, i from late union select doc_id, i2 from late where i2 is not null union select doc_id, i from alone where (doc_id, i) > f),
kept as (select l.doc_id, string_agg(l.l, chr(10) order by l.i) as t, count(*) as n_kept from lines l anti join gone g using (doc_id, i) group by l.doc_id),
counts as (select doc_id, count(*) as n_lines from lines group by doc_id),
solids as (select doc_id, count(*) as n_solid from solid group by doc_id),
lost as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, c.n_lines, coalesce(g.n_removed, 0) as n_removed, sha256(case when g.n_removed = s.n_solid then '' else coalesce(k.t, '') end) as kept_sha256
from documents d join counts c using (doc_id) left join lost g using (doc_id) left join kept k using (doc_id) left join solids s using (doc_id)
"""
