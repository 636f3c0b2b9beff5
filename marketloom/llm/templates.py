"""Line dedup by a tree of log templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Leading tokens on a line's path, below its token count.
DEPTH = 3
#: Share of its tokens beyond the path that a line has in common with its template.
SIMILARITY = 0.7
#: Documents in which a template recurs.
MIN_DOCS = 10
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
FIELD = "<*>"
#: Masked lines without a constant token: their form is the line itself, so rows of numbers recur only if their numbers do.
ONLY_FIELDS = r"^<\*>( <\*>)*$"


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """A row per line with a token: _id, _key, line (its number), masked (tokens, those with a digit as a field), leaf, form, only_fields.
    masked is written with them once: to mask the lines of busy leaves anew would take the same patterns over the whole text again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    df = df.select("_id", "_key", F.posexplode(F.split("_text", "\n")).alias("line", "_line"))
    line = F.btrim("_line", F.lit(BLANKS))
    line = F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, SPACE, " ")).otherwise(line)
    df = df.withColumn("_line", line).where("_line <> ''")
    masked = F.when(F.col("_line").rlike("[0-9]"), F.regexp_replace("_line", r"[^\x20]*[0-9][^\x20]*", FIELD)).otherwise(F.col("_line"))
    df = df.withColumn("masked", masked)
    size = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    df = df.withColumn("only_fields", F.col("masked").startswith(FIELD) & F.col("masked").rlike(ONLY_FIELDS))
    form = F.xxhash64(F.when(F.col("only_fields"), F.col("_line")).otherwise(F.col("masked")))
    return df.withColumn("leaf", F.xxhash64(size, F.substring_index("masked", " ", depth))).withColumn("form", form).drop("_line")


def leaf_templates(lines: DataFrame, depth: int, similarity: float, min_docs: int) -> DataFrame:
    """(leaf, form, template) of the lines that fit a generalised template of their leaf.

    Only groups with lines of more than one form in ``min_docs`` lines or more are opened; the first groups are the leaves. A
    position is fixed to its most frequent token if half the forms have it (ties: the smaller token), else it is a variable field.
    A line fits its group's template if ``similarity`` of its tokens below the tree path, which all lines of a leaf share, are the
    fixed ones, one of them no field; lines of nothing but fields take no part. A leaf may hold several templates: the
    forms that don't fit go on in smaller groups, each by the token that most forms of its group share with it at a position (but
    not all of them; ties: the first position), until no group can hold a template. Forms are counted once, however often they recur.
    """
    forms = lines.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("n"))
    busy = lambda own: own.groupBy("group").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("lines")).where((F.col("forms") > 1) & (F.col("lines") >= min_docs)).select("group", "forms")
    open_groups = materialize(busy(forms.withColumnRenamed("leaf", "group")), "open")
    found = forms.select("leaf", "form", F.col("leaf").alias("template")).limit(0)
    own = lines.where("NOT only_fields").join(open_groups.select(F.col("group").alias("leaf")), "leaf", "left_semi")
    own = own.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("n"), F.first("masked").alias("masked")).withColumn("group", F.col("leaf"))
    own = materialize(own.select("leaf", "form", "masked", "n", "group"), "forms")
    # the counts of groups are a small table of their own, so that a group with many forms is not dealt to one task
    open_groups = materialize(busy(own), "open")
    while not open_groups.isEmpty():
        tokens = own.join(open_groups, "group").select("group", "leaf", "form", "forms", F.posexplode(F.slice(F.split("masked", " "), depth + 1, F.size(F.split("masked", " ")))).alias("at", "token"))
        counts = tokens.groupBy("group", "at", "token").agg(F.count(F.lit(1)).alias("n"), F.first("forms").alias("forms"))
        counts = materialize(counts.where((F.col("n") > 1) | (F.col("forms") == 2)).drop("forms"), "counts")
        top = counts.groupBy("group", "at").agg(F.min(F.struct(-F.col("n"), "token")).alias("best")).select("group", "at", F.col("best.token").alias("token"), F.lit(True).alias("top"))
        counts = counts.join(top, ["group", "at", "token"], "left")
        hit = F.col("top") & (2 * F.col("n") >= F.col("forms"))
        shared = (F.col("n") > 1) & (F.col("n") < F.col("forms"))
        held = tokens.join(counts, ["group", "at", "token"]).groupBy("group", "leaf", "form").agg(
            F.count_if(hit).alias("hits"), F.count_if(hit & (F.col("token") != FIELD)).alias("constants"), F.min(F.when(shared, F.struct(-F.col("n"), "at", "token"))).alias("next"))
        held = own.join(held, ["group", "leaf", "form"]).withColumn("fits", (F.col("constants") > 0) & (F.col("hits") >= similarity * (F.size(F.split("masked", " ")) - depth)))
        held = materialize(held.select("group", "leaf", "form", "masked", "n", "fits", "next"), "held")
        found = found.unionByName(held.where("fits").select("leaf", "form", F.col("group").alias("template")))
        own = held.where("NOT fits AND next IS NOT NULL").withColumn("group", F.xxhash64("group", "next.at", "next.token"))
        own = materialize(own.select("leaf", "form", "masked", "n", "group"), "forms")
        open_groups = materialize(busy(own), "open")
    return found


def template_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id, _key, lines: the numbers of the lines to drop, a row per document that has any."""
    lines = materialize(_lines(docs, depth).select("_id", "_key", "line", "leaf", "form", "only_fields", "masked"), "lines")
    fits = materialize(leaf_templates(lines, depth, similarity, min_docs).withColumn("fits", F.lit(True)), "fits")
    lines = lines.join(fits, ["leaf", "form"], "left").withColumn("template", F.coalesce("template", "form"))
    lines = materialize(lines.select("_id", "_key", "line", "template", F.coalesce("fits", F.lit(False)).alias("fits")), "templates")
    seen = lines.select("template", "fits", "_id", "_key").distinct().groupBy("template", "fits").agg(F.count(F.lit(1)).alias("docs"))
    often = materialize(seen.where(F.col("docs") >= min_docs).select("template", "fits"), "recurring")
    held = materialize(lines.join(often, ["template", "fits"]), "held")
    first = materialize(held.groupBy("template", "fits").agg(F.min(F.struct("_id", "_key")).alias("first")), "first")
    drop = held.join(first, ["template", "fits"]).where(F.struct("_id", "_key") != F.col("first"))
    return drop.groupBy("_id", "_key").agg(F.collect_set("line").alias("lines"))


def drop_template_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped, and n_lines and n_dropped added (unless ``counts`` is false).

    A line's path in the tree is its token count, then ``depth`` leading tokens; tokens with digits are fields. Below a leaf the
    positions whose token varies become fields too, and lines close to that template are its instances; other lines are their
    own. A template that ``min_docs`` documents hold is dropped everywhere but in the first of them (smallest id, then by a hash
    of the text), so that text which copies share survives once. Lines without a token stay. Null text stays null, with 0 lines;
    null ids come last; rows with equal id and text are one document, others are not, whatever their ids; a text of any length is
    taken whole, a row per line. Columns of ``docs`` are kept, but for ones called n_lines and n_dropped, which are replaced if
    ``counts`` is set. An empty table gives an empty one.
    """
    drop = template_lines(docs, depth, similarity, min_docs)
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("whole"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"))
    out = keyed.join(drop, ["_id", "_key"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda l, i: ~F.array_contains("lines", i)), "\n")
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    new = F.when(F.col("lines").isNull(), F.col("text")).otherwise(left)
    kept = [new.alias("text") if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if not counts:
        return out.select(*kept)
    return out.select(*kept, n_lines.alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))


def op4_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_template_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: Rounds of splitting groups that the SQL states one by one; it fails where a group is still open after them.
LEVELS = 12


def op4_sql() -> str:
    def level(k: int) -> str:
        return f"""
    open{k} AS (SELECT grp, count(*) AS forms FROM own{k} GROUP BY grp HAVING count(*) > 1 AND sum(n) >= {MIN_DOCS}),
    tok{k} AS (SELECT grp, form, forms, unnest(f[{DEPTH + 1}:]) AS token, unnest(range(greatest(len(f) - {DEPTH}, 0))) AS pos FROM own{k} JOIN open{k} USING (grp)),
    cnt{k} AS (SELECT grp, pos, token, count(*) AS n, any_value(forms) AS forms FROM tok{k} GROUP BY ALL HAVING count(*) > 1 OR any_value(forms) = 2),
    top{k} AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY n DESC, token) = 1 AND 2 * n >= forms AS hit FROM cnt{k}),
    held{k} AS (SELECT grp, form, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND token <> '{FIELD}') AS constants,
                min({{'m': -n, 'pos': pos, 'token': token}}) FILTER (WHERE n > 1 AND n < t.forms) AS nxt FROM tok{k} t JOIN top{k} USING (grp, pos, token) GROUP BY ALL),
    fit{k} AS (SELECT own{k}.*, nxt, constants > 0 AND hits >= {SIMILARITY} * (len(f) - {DEPTH}) AS fits FROM own{k} JOIN held{k} USING (grp, form)),
    own{k + 1} AS (SELECT size, head, form, f, n, grp || chr(1) || nxt.pos || chr(1) || nxt.token AS grp FROM fit{k} WHERE NOT fits AND nxt IS NOT NULL)"""

    levels = ",".join(level(k) for k in range(LEVELS))
    found = " UNION ALL ".join(f"SELECT form, grp FROM fit{k} WHERE fits" for k in range(LEVELS))
    return rf"""
    WITH d AS (SELECT doc_id, text FROM documents),
    e AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS x FROM d WHERE text IS NOT NULL),
    w AS (SELECT doc_id, line, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS raw FROM e),
    m AS (SELECT doc_id, line, array_to_string(raw, ' ') AS plain, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS f FROM w WHERE len(raw) > 0),
    l AS (SELECT doc_id, line, len(f) AS size, array_to_string(f[1:{DEPTH}], ' ') AS head, f, len(list_filter(f, lambda t: t <> '{FIELD}')) = 0 AS only_fields,
            CASE WHEN len(list_filter(f, lambda t: t <> '{FIELD}')) = 0 THEN plain ELSE array_to_string(f, ' ') END AS form FROM m),
    own0 AS (SELECT size, head, form, f, count(*) AS n, size || chr(1) || head AS grp FROM l WHERE NOT only_fields GROUP BY ALL),{levels},
    late AS (SELECT CASE WHEN count(*) > 0 THEN error('groups are still open') END AS x FROM (SELECT grp FROM own{LEVELS} GROUP BY grp HAVING count(*) > 1 AND sum(n) >= {MIN_DOCS})),
    found AS ({found}),
    z AS (SELECT doc_id, line, coalesce('g' || grp, 'f' || l.form) AS own FROM l LEFT JOIN found ON found.form = l.form AND NOT l.only_fields),
    often AS (SELECT own, min(doc_id) AS first FROM z GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    gone AS (SELECT doc_id, line FROM z JOIN often USING (own) WHERE doc_id <> first),
    kept AS (SELECT e.doc_id, string_agg(x, chr(10) ORDER BY e.line) FILTER (WHERE gone.line IS NULL) AS text, count(gone.line) AS n_dropped FROM e LEFT JOIN gone USING (doc_id, line) GROUP BY ALL)
    SELECT d.doc_id, (CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
      CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM d LEFT JOIN kept USING (doc_id) WHERE (SELECT x FROM late) IS NULL
    """


QUERIES = {"op4_line_templates": op4_line_templates}
SQL = {"op4_line_templates": op4_sql()}
