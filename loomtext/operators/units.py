"""Alignment units: targets, tokens, effective units after edits, phrase location."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import SPEAKERS, TOKEN


def unit_targets(alignments: DataFrame) -> DataFrame:
    """One row per (unit, witness): text, token ids, their range, method.

    A repeated unit counts once.  Witnesses named in any of the maps appear;
    null maps and lists are empty, an id without a number gives no range.
    """
    a = alignments.where("unit_id is not null").dropDuplicates(["unit_id"])
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("targets", "target_token_ids")]))
    t = a.select("unit_id", "bitext_id", "passage_id", "unit_number", "unit_order", "unit_status", F.explode(keys).alias("witness"), "targets", "target_token_ids", "mapping_methods")
    ids = F.coalesce(F.try_element_at("target_token_ids", F.col("witness")), F.array().cast("array<string>"))
    t = t.select("unit_id", "bitext_id", "passage_id", "unit_number", "unit_order", "unit_status", "witness",
                 F.try_element_at("targets", F.col("witness")).alias("text"), ids.alias("token_ids"), F.try_element_at("mapping_methods", F.col("witness")).alias("method"))
    n = F.transform("token_ids", lambda x: F.regexp_extract(x, r"-t(\d+)$", 1).try_cast("int"))
    return t.withColumn("lo", F.array_min(n)).withColumn("hi", F.array_max(n)).withColumn("n_tokens", F.size("token_ids").cast("bigint"))


def target_problems(targets: DataFrame) -> DataFrame:
    """unit_id, witness, problem: repeated ids, or ids that are not contiguous."""
    p = F.when(F.size(F.array_distinct("token_ids")) < F.col("n_tokens"), "repeated").when(F.col("hi") - F.col("lo") + 1 != F.col("n_tokens"), "not contiguous")
    return targets.where("n_tokens > 0").select("unit_id", "witness", p.alias("problem")).where("problem is not null")


def token_units(targets: DataFrame) -> DataFrame:
    """token_id, unit_id: the last unit of a token by order, then id."""
    t = targets.select(F.explode("token_ids").alias("token_id"), "unit_id", "unit_order")
    return t.groupBy("token_id").agg(F.max_by("unit_id", F.struct("unit_order", "unit_id")).alias("unit_id"))


def token_alignment(targets: DataFrame) -> DataFrame:
    """token_id, unit_id: the unit with the shortest target of the token's witness, then the smaller id."""
    t = targets.select(F.explode("token_ids").alias("token_id"), "unit_id", "n_tokens")
    return t.groupBy("token_id").agg(F.min_by("unit_id", F.struct("n_tokens", "unit_id")).alias("unit_id"))


def fill_missing(targets: DataFrame, base: DataFrame) -> DataFrame:
    """Targets with text missing filled from ``base`` (bitext_id, unit_number, witness, base_text), by number."""
    j = targets.join(base, ["bitext_id", "unit_number", "witness"], "left")
    return j.withColumn("text", F.coalesce(F.when(F.length("text") > 0, F.col("text")), F.col("base_text"))).drop("base_text")


def effective_units(units: DataFrame, moves: DataFrame, sections: DataFrame) -> DataFrame:
    """Unit tokens after boundary moves and section edits.

    ``units``: unit_id, token_id, idx; ``moves``: token_id, to_unit, seq (the
    last move of a token wins); ``sections``: unit_id, deleted, seq (the last
    wins; deleted units are hidden with their tokens).
    """
    mv = moves.groupBy("token_id").agg(F.max_by("to_unit", "seq").alias("to_unit"))
    sec = sections.groupBy("unit_id").agg(F.max_by("deleted", "seq").alias("deleted"))
    u = units.join(mv, "token_id", "left").select("token_id", "idx", F.coalesce("to_unit", "unit_id").alias("unit_id"))
    return u.join(sec.where("deleted"), "unit_id", "left_anti")


def override(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Machine units that share no token with a human unit, together with the human ones."""
    h = human.select(F.explode("token_ids").alias("token_id"))
    hit = machine.select("unit_id", F.explode("token_ids").alias("token_id")).join(h, "token_id", "left_semi").select("unit_id").distinct()
    return human.unionByName(machine.join(hit, "unit_id", "left_anti"))


def unique_phrases(texts: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phrase, start_pos: phrases found exactly once in all texts of their keys.

    White space is compared as one blank.  ``texts``: keys, text; ``phrases``: keys, phrase.
    """
    sq = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    t = texts.select(*keys, sq("text").alias("text")).where("text <> ''").distinct()
    p = phrases.select(*keys, sq("phrase").alias("phrase")).where("phrase <> ''").distinct()
    count = F.expr("(length(text) - length(replace(text, phrase, ''))) div length(phrase)")
    j = t.join(p, keys).where("contains(text, phrase)").withColumn("c", count)
    return j.groupBy(*keys, "phrase").agg(F.sum("c").alias("c"), F.min(F.expr("locate(phrase, text) - 1")).alias("start_pos")).where("c = 1").drop("c")


def marker_slices(texts: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """key, n, slice: the text cut at ordered markers, each searched behind the one before.

    A missing marker makes the row fail, as a wrong cut would shift all after it.
    """
    cuts = F.array().cast("array<int>")
    at = F.lit(0)
    for m in markers:
        at = F.call_function("locate", F.lit(m), F.col("text"), at + 1) - 1
        at = F.when(at < 0, F.raise_error(F.lit("marker not found"))).otherwise(at).cast("int")
        cuts = F.concat(cuts, F.array(at))
    d = texts.select(key, "text", F.concat(cuts, F.array(F.length("text"))).alias("c"))
    n = F.sequence(F.lit(1), F.lit(len(markers)))
    return d.select(key, F.posexplode(F.transform(n, lambda i: F.substring(F.col("text"), F.element_at("c", i) + 1, F.element_at("c", i + 1) - F.element_at("c", i)))).alias("n", "slice"))


DANDA = r"\|+|[।॥]+|/+|\n[ \t]*\n+"


def danda_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, start_pos, end_pos: sentences closed by shads, dandas, slashes or blank lines.

    A piece of nothing but marks and digits extends the sentence before it if
    it holds a digit, and is dropped otherwise.
    """
    part = rf"[^|।॥/\n]*(?:\n(?![ \t]*\n)[^|।॥/\n]*)*(?:{DANDA}|$)"
    p = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(part), F.lit(0))).alias("pos", "s")).where("s <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    p = p.withColumn("b", F.sum(F.length("s")).over(w)).withColumn("a", F.col("b") - F.length("s"))
    body = F.regexp_replace(F.regexp_replace("s", r"(?i)\(\s*Vvs[_\s-]*\d+\s*\)", ""), r"[\s|/।॥\d()._-]+", "")
    p = p.withColumn("full", body != "").withColumn("digit", F.col("s").rlike(r"\d"))
    p = p.withColumn("no", F.sum(F.when(F.col("full"), 1).otherwise(0)).over(w)).where("no > 0 and (full or digit)")
    lead = F.regexp_extract("s", r"^(?i:\(\s*Vvs[_\s-]*\d+\s*\))?\s*", 0)
    p = p.withColumn("a", F.when(F.col("full"), F.col("a") + F.length(lead)))
    p = p.withColumn("b", F.when(F.col("full"), F.col("b") - F.length(F.regexp_extract("s", r"\s*$", 0))).otherwise(F.col("b")))
    return p.groupBy(key, "no").agg(F.min("a").alias("start_pos"), F.max("b").alias("end_pos"))


def label_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_labels: number labels ('1.2. ') at line starts."""
    return docs.select(key, F.size(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\d+(?:\.\d+)+\.[ \t]+"), F.lit(0))).cast("bigint").alias("n_labels"))


def span_text(tokens: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, span_text: the selected tokens' text; separate runs joined by ' … '.

    ``tokens``: key, idx, start_pos, end_pos; ``texts``: key, text.
    """
    w = Window.partitionBy(key).orderBy("idx")
    g = tokens.withColumn("g", F.col("idx") - F.row_number().over(w)).groupBy(key, "g").agg(F.min("start_pos").alias("a"), F.max("end_pos").alias("b"))
    s = g.join(texts, key).select(key, "a", F.expr("substring(text, a + 1, b - a)").alias("s"))
    return s.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "s"))), lambda x: x.s), " … ").alias("span_text"))


def context_groups(units: DataFrame, keys: list[str], order: str, most: int = 4) -> DataFrame:
    """keys, first, size, text: groups of 1 to ``most`` consecutive units."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = units.select(*keys, order, "text", *[F.lead("text", i).over(w).alias(f"_t{i}") for i in range(1, most)])
    parts = [F.col("text")] + [F.col(f"_t{i}") for i in range(1, most)]
    sizes = F.array(*[F.when(parts[n - 1].isNotNull(), F.struct(F.lit(n).cast("bigint").alias("size"), F.concat_ws(" ", *parts[:n]).alias("text"))) for n in range(1, most + 1)])
    return ahead.select(*keys, F.col(order).alias("first"), F.inline(F.filter(sizes, lambda x: x.isNotNull())))


def chunk_runs(tokens: DataFrame, key: str, least_chars: int = 18):
    """key, lo, hi: free tokens cut into clauses (sequential, one task per key).

    ``tokens``: key, idx, surface, gap (text up to the next token).  A chunk
    closes at a sentence mark from four tokens on unless after an abbreviation,
    at a comma or colon from 75, and at 110; ones of less than four tokens or
    ``least_chars`` characters (without labels) are dropped.
    """
    import pandas as pd

    label = re.compile(rf"\[(?:{'|'.join(SPEAKERS)}|\d+[a-d]*)[:.]?\]", re.IGNORECASE)

    stop = {"etc", "e", "g", "i", "viz", "d", "h", "usw", "b", "tzn"}  # fixed values
    kind = tokens.schema[key].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        out, cur, last = [], [], None
        rows = list(zip(g["idx"], g["surface"], g["gap"]))
        for n, (i, s, gap) in enumerate(rows):
            if last is not None and i != last + 1:
                cur = []
            cur.append(i)
            last = i
            gap = gap or ""
            end = len(cur) >= 4 and s.casefold() not in stop and any(c in ".!?;。！？；।" for c in gap)
            soft = len(cur) >= 75 and any(c in ",，:" for c in gap)
            final = n + 1 == len(rows) or rows[n + 1][0] != i + 1
            if end or soft or len(cur) >= 110 or final:
                words = "".join(x + (y or "") for _, x, y in rows[n + 1 - len(cur):n]) + s if cur else ""
                if len(cur) >= 4 and len(" ".join(label.sub(" ", words).split())) >= least_chars:
                    out.append((g[key].iloc[0], cur[0], cur[-1]))
                cur = []
        return pd.DataFrame(out, columns=[key, "lo", "hi"])

    return tokens.groupBy(key).applyInPandas(run, f"{key} {kind}, lo bigint, hi bigint")


def gaps_after(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx, surface, gap: tokens with the text between them and the next."""
    part = rf"(?:{TOKEN})[^\p{{L}}\p{{M}}\p{{N}}]*"
    p = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(part), F.lit(0))).alias("idx", "s"))
    return p.select(key, "idx", F.regexp_extract("s", TOKEN, 0).alias("surface"), F.regexp_replace("s", "^(?:" + TOKEN + ")", "").alias("gap"))
