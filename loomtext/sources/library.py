"""Document library: blocks to passages, plan merges, fragments at markers, token runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.operators.spans import text_spans


def passage_texts(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """passage_id, source_id, text: the fragments' slices joined by blank lines.

    ``fragments``: passage_id, source_id, ord, component_id, block_id, start_pos,
    end_pos (null: the whole block); ``blocks``: component_id, block_id, text.
    Fragments of unknown blocks, or out of bounds, are left out here and listed
    by ``fragment_problems``.
    """
    j = fragments.join(blocks, ["component_id", "block_id"]).where("start_pos is null or (start_pos >= 0 and start_pos < end_pos and end_pos <= length(text))")
    s = j.select("passage_id", "source_id", "ord", F.when(F.col("start_pos").isNull(), F.col("text")).otherwise(F.expr("substring(text, start_pos + 1, end_pos - start_pos)")).alias("t"))
    g = s.groupBy("passage_id", "source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x"))
    return g.select("passage_id", "source_id", F.array_join(F.transform("x", lambda x: x.t), "\n\n").alias("text")).where("trim(text) <> ''")


def fragment_problems(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fragments that name an unknown block or leave its bounds."""
    j = fragments.join(blocks, ["component_id", "block_id"], "left")
    bad = F.when(F.col("text").isNull(), "unknown block").when(F.expr("start_pos < 0 or start_pos >= end_pos or end_pos > length(text)"), "bounds")
    return j.select("passage_id", "source_id", "block_id", bad.alias("problem")).where("problem is not null")


def merge_plan(library: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components with the plan's added, conflicts): an equal component is no change, a different one a conflict.

    Both: document_id, component_id, content.
    """
    a, b = library.alias("a"), plan.alias("b")
    on = F.expr("a.document_id = b.document_id and a.component_id = b.component_id")
    conflicts = a.join(b, on).where("not (a.content <=> b.content)").select("a.document_id", "a.component_id")
    new = b.join(a, on, "left_anti").join(library.select(F.col("document_id").alias("known")).distinct(), F.expr("b.document_id = known"), "left_semi")
    return library.unionByName(new.select("document_id", "component_id", "content")), conflicts


def replace_mapping(mappings: DataFrame, readings: DataFrame) -> DataFrame:
    """Mappings with those of the readings' (source_id, passage_id) replaced."""
    keys = ["source_id", "passage_id"]
    return mappings.join(readings.select(*keys).distinct(), keys, "left_anti").unionByName(readings)


def split_at_markers(parts: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc, n, block_id, start_pos, end_pos: a flattened document cut at global positions.

    ``parts``: doc, ord, block_id, text; ``cuts``: doc, at (sorted places in the
    joined text).  Slices are told back as places inside their blocks.
    """
    w = Window.partitionBy("doc").orderBy("ord")
    p = parts.withColumn("b", F.sum(F.length("text")).over(w)).withColumn("a", F.col("b") - F.length("text"))
    total = p.groupBy("doc").agg(F.max("b").alias("total"))
    c = cuts.select("doc", "at").distinct().unionByName(p.select("doc", F.lit(0).alias("at")).distinct()).distinct()
    v = Window.partitionBy("doc").orderBy("at")
    c = c.join(total, "doc").where("at < total").withColumn("to", F.coalesce(F.lead("at").over(v), F.col("total"))).withColumn("n", F.row_number().over(v))
    j = p.alias("p").join(c.alias("c"), F.expr("p.doc = c.doc and p.a < c.to and p.b > c.at"))
    return j.select("p.doc", "c.n", "p.block_id", F.expr("greatest(c.at, p.a) - p.a").alias("start_pos"), F.expr("least(c.to, p.b) - p.a").alias("end_pos")).where("start_pos < end_pos")


def _run_problem() -> Column:
    return F.when(F.col("lo").isNull(), "empty").when(F.col("cuts"), "cuts a token").when(F.col("lo") <= F.col("prev") + 1, "skips no token")


def text_token_runs(docs: DataFrame, doc_id: str, text: str, spans: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, problems) as of ``token_runs``, for spans of the text in the same row (see ``text_spans``): doc_id, no, lo, hi or problem."""
    g = text_spans(docs, doc_id, text, spans)
    cuts = F.coalesce((F.col("lo") < F.col("in_lo")) | (F.col("hi") > F.col("in_hi")), F.lit(False))
    g = g.select(doc_id, "no", F.col("in_lo").alias("lo"), F.col("in_hi").alias("hi"), cuts.alias("cuts"), "prev").withColumn("problem", _run_problem())
    return g.where("problem is null").select(doc_id, "no", "lo", "hi"), g.where("problem is not null").select(doc_id, "no", "problem")


def token_runs(spans: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, problems) of selections by code point spans.

    ``spans``: unit_id, key, no, start_pos, end_pos; ``tokens``: key, idx,
    start_pos, end_pos.  A run holds the tokens inside its span; a span that
    cuts a token, holds none, or follows the run before without skipping a
    token is a problem.
    """
    on = "s.key = t.key and t.start_pos < s.end_pos and t.end_pos > s.start_pos"
    j = spans.alias("s").join(tokens.alias("t"), F.expr(on), "left")
    inside = F.expr("t.start_pos >= s.start_pos and t.end_pos <= s.end_pos")
    g = j.groupBy("s.unit_id", "s.key", "s.no").agg(
        F.min(F.when(inside, F.col("t.idx"))).alias("lo"), F.max(F.when(inside, F.col("t.idx"))).alias("hi"), F.max(F.coalesce(~inside & F.col("t.idx").isNotNull(), F.lit(False))).alias("cuts"))
    w = Window.partitionBy("unit_id", "key").orderBy("no")
    g = g.withColumn("prev", F.lag("hi").over(w)).withColumn("problem", _run_problem())
    return g.where("problem is null").select("unit_id", "key", "no", "lo", "hi"), g.where("problem is not null").select("unit_id", "no", "problem")


#: An edit of a witness's text in an override file.
OVERRIDES = (
    "units array<struct<id:string,parentId:string,label:string,createdAt:string>>, "
    "alignments array<struct<id:string,verse:int,level:string,status:string,targetTokenIds:map<string,array<string>>,createdAt:string>>, "
    "sentenceEdits array<struct<id:string,passageId:string,sourceId:string,tokenIds:array<string>,selectedText:string,toUnitId:string,createdAt:string>>, "
    "sectionEdits array<struct<id:string,unitId:string,passageId:string,number:string,label:string,order:double,level:string,note:string,targetTexts:map<string,string>,targetTextsVersion:int,deleted:boolean,createdAt:string>>, "
    "textEdits array<struct<id:string,passageId:string,sourceId:string,text:string,note:string,updatedAt:string>>, "
    "lexiconEntries array<struct<id:string,sourceId:string,tokenId:string,surface:string,lemma:string,gloss:string,updatedAt:string>>, "
    "syntaxAnnotations array<struct<id:string,sourceId:string,passageId:string,sentenceId:string,note:string,updatedAt:string>>"
)


def read_overrides(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Published editorial data of an override file, one frame per collection with ``seq``, the place in the file.

    A collection the file lacks is empty; a file that is no JSON object gives empty collections.
    """
    root = spark.read.schema(OVERRIDES).json(path, multiLine=True)
    return {f.name: root.select(F.posexplode(f.name).alias("seq", "_v")).select("seq", "_v.*") for f in root.schema.fields}


def save_drafts(drafts: dict[str, DataFrame], path: str) -> None:
    """Write local drafts, one folder per collection; a save replaces the one before as a whole."""
    for name, d in drafts.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")


def load_drafts(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Local drafts as saved; a collection that was never saved is empty."""
    jvm = spark._jvm
    out = {}
    for name, ddl in schemas.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        out[name] = spark.read.schema(ddl).parquet(f"{path}/{name}") if there else spark.createDataFrame([], ddl)
    return out


def clause_mappings(texts: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, problems) of clauses given by the words they start with.

    ``texts``: source, passage, text; ``clauses``: source, passage, ord, units (list), marker, end_marker (null: up to the next
    clause).  A marker must stand once, blanks apart, and clauses rise.  Mappings: source, passage, unit, start_pos,
    end_pos (blanks at the end left out), group_id where several units share the clause.  A passage with a problem has
    no mapping: 'no text', 'not found', 'not unique', 'order', 'no end'.
    """
    k = ["source", "passage"]
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    j = clauses.join(texts, k, "left").withColumn("_m", bare(F.col("marker"))).withColumn("_b", bare(F.col("text")))
    n = F.when(F.length("_m") > 0, (F.length("_b") - F.length(F.replace(F.col("_b"), F.col("_m"), F.lit("")))) / F.length("_m")).otherwise(0)

    def place(marker: str, behind: bool) -> Column:
        """Place in the text of the marker's first (or last) character: blanks are counted in again."""
        at = F.expr(f"locate({marker}, _b)") + (F.length(marker) - 1 if behind else 0)
        # The n-th character that is no blank: cut the text at its blanks and count.
        lens = F.transform(F.split("text", ""), lambda c: F.when(c.rlike(r"^\s$"), 0).otherwise(1))
        spots = F.filter(F.transform(lens, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
        return F.get(spots, (at - 1).cast("int")) + (1 if behind else 0)

    j = j.withColumn("_n", n).withColumn("start_pos", F.when(F.col("_n") == 1, place("_m", False)))
    w = Window.partitionBy(*k).orderBy("ord")
    j = j.withColumn("_next", F.lead("start_pos").over(w)).withColumn("_prev", F.max("start_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    j = j.withColumn("_e", bare(F.col("end_marker"))).withColumn("_end", F.when(F.col("_e").isNotNull(), F.when(F.expr("locate(_e, _b)") > 0, place("_e", False))).otherwise(F.coalesce("_next", F.length("text"))))
    problem = (F.when(F.col("text").isNull(), "no text").when(F.col("_n") == 0, "not found").when(F.col("_n") > 1, "not unique").when(F.col("start_pos") <= F.col("_prev"), "order")
               .when(F.col("_end").isNull() | (F.col("_end") <= F.col("start_pos")), "no end"))
    j = j.withColumn("problem", problem)
    bad = j.where("problem is not null")
    ok = j.join(bad.select(*k).distinct(), k, "left_anti")
    cut = F.expr("substring(text, start_pos + 1, _end - start_pos)")
    ok = ok.withColumn("end_pos", F.col("start_pos") + F.length(F.regexp_replace(cut, r"\s+$", "")))
    group = F.when(F.size("units") > 1, F.concat_ws("-", *k, "ord"))
    return ok.select(*k, F.explode("units").alias("unit"), "start_pos", "end_pos", group.alias("group_id")), bad.select(*k, "ord", "problem")
