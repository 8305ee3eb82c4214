"""A seed graph of three chapters of the civil code's law of obligations, as node and edge tables.

Articles' texts are not repeated here: `with_texts` takes them from a table of landed articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statute, parts and chapters (id, label, type, what it is part of).
ABOVE = (
    ("stat-civil", "民法", "Statute", None),
    ("part-obligation", "債編", "Part", "stat-civil"),
    ("part-obligation-general", "債編總論", "Part", "part-obligation"),
    ("part-obligation-specific", "債編各論", "Part", "part-obligation"),
    ("ch-sale", "買賣", "Chapter", "part-obligation-specific"),
    ("ch-lease", "租賃", "Chapter", "part-obligation-specific"),
    ("ch-tort", "侵權行為", "Chapter", "part-obligation-general"),
    ("ch-general-performance", "債之效力", "Chapter", "part-obligation-general"),
)
# The articles of each chapter, by number.
ARTICLES = {
    "ch-sale": {
        "345": "買賣之定義", "346": "價金之決定", "347": "買賣之成立", "348": "物之出賣人義務", "349": "權利瑕疵擔保", "350": "權利瑕疵擔保之免除", "354": "物之瑕疵擔保", "355": "瑕疵擔保責任之免除",
        "356": "買受人之檢查通知義務", "359": "瑕疵擔保之效力", "360": "瑕疵擔保之請求損害賠償", "364": "種類買賣之瑕疵擔保", "365": "瑕疵擔保請求權之除斥期間", "367": "買受人之義務", "373": "危險負擔",
    },
    "ch-lease": {
        "421": "租賃之定義", "422": "不動產租賃之方式", "423": "出租人之交付義務", "429": "出租人之修繕義務", "430": "修繕義務不履行之效力", "431": "有益費用之償還", "432": "承租人之保管義務", "433": "失火責任",
        "440": "租金遲延之效力", "443": "轉租之效力", "450": "租賃之消滅", "451": "默示更新",
    },
    "ch-tort": {
        "184": "一般侵權行為", "185": "共同侵權行為", "186": "公務員侵權責任", "187": "法定代理人之責任", "188": "僱用人責任", "189": "定作人責任", "190": "動物占有人責任", "191": "工作物所有人責任", "191-3": "危險事業責任",
        "192": "侵害生命權之損害賠償", "193": "侵害身體健康之損害賠償", "194": "侵害生命權之慰撫金", "195": "侵害人格權之慰撫金", "196": "物之毀損賠償", "197": "侵權行為請求權之消滅時效", "198": "時效完成後之拒絕給付權",
    },
    "ch-general-performance": {"227": "不完全給付"},
}
# Concepts, each with the articles that it refers to.
CONCEPTS = {
    "con-warranty": ("物之瑕疵擔保", ("354", "359")),
    "con-right-warranty": ("權利瑕疵擔保", ("349",)),
    "con-tort": ("侵權行為", ("184", "185", "188")),
    "con-lease": ("租賃", ("421",)),
    "con-sale": ("買賣契約", ("345",)),
    "con-imputation": ("歸責事由", ("184",)),
    "con-limiting": ("消滅時效", ("197",)),
    "con-damages": ("損害賠償", ("192", "193", "194", "195")),
}
# Relations between articles (from, to, type), after the chapter that they follow.
RELATIONS = {
    "ch-sale": (
        ("354", "347", "references"), ("359", "354", "references"), ("360", "354", "references"), ("365", "356", "references"), ("354", "373", "references"), ("355", "354", "exception_to"),
    ),
    "ch-lease": (("430", "429", "references"), ("440", "421", "references"), ("451", "450", "exception_to")),
    "ch-tort": (
        ("185", "184", "references"), ("187", "184", "references"), ("188", "184", "references"), ("190", "184", "references"), ("191", "184", "references"), ("191-3", "184", "references"), ("197", "184", "references"),
        ("184", "191", "conflicts_with"), ("227", "354", "supplements"),
    ),
}
# What is known of nodes besides.
METADATA = {"part-obligation": {"sub": "第二編"}, "ch-sale": {"articles": "§345-§397"}, "ch-lease": {"articles": "§421-§463"}, "ch-tort": {"articles": "§184-§198"}}


def node_rows() -> list[tuple[str, str, str]]:
    """(id, label, type) in the order in which searches and counts meet them: the parts, each chapter before its articles (the last one after its only article), the concepts."""
    out = [x[:3] for x in ABOVE if x[2] != "Chapter"]
    for chapter, label, kind, _ in (x for x in ABOVE if x[2] == "Chapter"):
        own = [(f"art-{no}", f"§{no} {title}", "Article") for no, title in ARTICLES[chapter].items()]
        out += [*own, (chapter, label, kind)] if chapter == "ch-general-performance" else [(chapter, label, kind), *own]
    return out + [(c, label, "Concept") for c, (label, _) in CONCEPTS.items()]


def edge_rows() -> list[tuple[str, str, str]]:
    """(src, dst, type), in such an order too."""
    out = [(up, c, "has_part") for c, _, kind, up in ABOVE if up and kind != "Chapter"]
    for chapter, _, _, up in (x for x in ABOVE if x[2] == "Chapter"):
        out += [(up, chapter, "has_part"), *((chapter, f"art-{no}", "has_part") for no in ARTICLES[chapter])]
        out += [(f"art-{a}", f"art-{b}", kind) for a, b, kind in RELATIONS.get(chapter, ())]
    return out + [(c, f"art-{no}", "references") for c, (_, own) in CONCEPTS.items() for no in own]


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label, type, metadata, place) and edges(src, dst, type, place); place is that of insertion."""
    nodes = [(*x, METADATA.get(x[0], {}), k) for k, x in enumerate(node_rows())]
    edges = [(*x, k) for k, x in enumerate(edge_rows())]
    return spark.createDataFrame(nodes, "id string, label string, type string, metadata map<string,string>, place int"), spark.createDataFrame(edges, "src string, dst string, type string, place int")


def with_texts(nodes: DataFrame, articles: DataFrame) -> DataFrame:
    """nodes with the text of articles(article_no, text) in their metadata, where there is one; of several the least."""
    texts = articles.where("text IS NOT NULL").groupBy(F.concat(F.lit("art-"), "article_no").alias("id")).agg(F.min("text").alias("text"))
    known = F.map_concat(F.map_filter("metadata", lambda k, _: k != "text"), F.when(F.col("text").isNotNull(), F.create_map(F.lit("text"), "text")).otherwise(F.create_map().cast("map<string,string>")))
    return nodes.join(texts, "id", "left").withColumn("metadata", known).drop("text")
