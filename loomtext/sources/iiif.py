"""IIIF presentation manifests and page layouts of scanned text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SERVICE = "array<struct<id:string,`@id`:string,type:string,`@context`:string>>"
_BODY = f"struct<width:int,height:int,service:{_SERVICE}>"
MANIFEST3 = f"struct<items:array<struct<id:string,width:int,height:int,label:map<string,array<string>>,items:array<struct<items:array<struct<target:string,body:{_BODY}>>>>>>>"


def canvases(manifests: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(canvases, rejected) of presentation 3 manifests held as JSON text.

    A canvas needs exactly one painted image of its own size, painted on the
    whole canvas, with an HTTPS image service.
    """
    c = manifests.select(F.from_json(json, MANIFEST3).alias("m")).select(F.explode("m.items").alias("c"))
    paints = F.flatten(F.transform("c.items", lambda p: F.coalesce(p["items"], F.array())))
    c = c.select(F.col("c.id").alias("canvas_id"), "c.width", "c.height", F.array_join(F.flatten(F.map_values("c.label")), " ").alias("label"), paints.alias("p"))
    c = c.withColumn("one", F.try_element_at("p", F.lit(1)))
    service = F.try_element_at(F.filter("one.body.service", lambda s: s["type"].rlike("ImageService[23]") | s["@context"].contains("image")), F.lit(1))
    c = c.withColumn("url", F.regexp_replace(F.coalesce(service["id"], service["@id"]), "/$", ""))
    reason = (
        F.when(F.coalesce(F.size("p"), F.lit(0)) != 1, "not one image").when(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "no image service")
        .when(~((F.col("one.body.width") == F.col("width")) & (F.col("one.body.height") == F.col("height"))), "other size").when(F.col("one.target").contains("#"), "part of the canvas"))
    c = c.withColumn("reason", reason)
    return (c.where("reason is null").select("canvas_id", "label", "width", "height", F.concat("url", F.lit("/info.json")).alias("info")), c.where("reason is not null").select("canvas_id", "reason"))


def layout_lines(spans: DataFrame, gap: float = 5.0) -> DataFrame:
    """page, side, line, text, baseline from positioned spans of scanned pages.

    ``spans``: page, width, x0, x1, x, y, slope, text.  A span belongs to the left
    side if its middle lies left of .515 of the page; its baseline is taken at
    that side's anchor.  A line collects spans within ``gap`` of its first
    baseline, so lines are built in order, one page side per task group.
    """
    side = F.when((F.col("x0") + F.col("x1")) / 2 < F.col("width") * 0.515, "left").otherwise("right")
    s = spans.withColumn("side", side)
    anchor = F.col("width") * F.when(F.col("side") == "left", 0.13).otherwise(0.53)
    s = s.withColumn("base", F.col("y") - F.coalesce("slope", F.lit(0.0)) * (F.col("x") - anchor))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("base", kind="stable")
        line, first, nos = 0, None, []
        for b in g["base"]:
            if first is None or abs(b - first) >= gap:
                line, first = line + 1, b
            nos.append(line)
        g = g.assign(line=nos, text=g["text"].fillna("")).sort_values(["line", "x"], kind="stable")
        out = g.groupby("line").agg(text=("text", "".join), baseline=("base", "min")).reset_index()
        out["text"] = out["text"].str.split().str.join(" ")
        out["page"], out["side"], out["baseline"] = g["page"].iloc[0], g["side"].iloc[0], out["baseline"].round(2)
        return out.loc[out["text"] != "", ["page", "side", "line", "text", "baseline"]]

    return s.groupBy("page", "side").applyInPandas(build, "page int, side string, line int, text string, baseline double")
