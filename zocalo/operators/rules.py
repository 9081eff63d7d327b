"""Business rules fired by the words of a text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.functions.sets import given, none, ordered_union
from zocalo.functions.text import clean_spaces, fold, strip_marks


@dataclass(frozen=True)
class Rule:
    id: str
    activation: list[str]
    exclusion: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    alternatives: list[tuple[str, list[str]]] = field(default_factory=list)
    text: str = ""


# The global rules with their trigger words, tables and wording.
RULES = [
    Rule("geografia_estado", ["estado", "estados", "uf"], ["estado de la orden", "order_status", "estado del pedido"],
         ["olist_customers_dataset"], [("vendedor|vendedores|seller", ["olist_sellers_dataset"])],
         "Cuando la pregunta hable de \"estados\" sin indicar de quién, se refiere al estado del cliente (customer_state). "
         "Si menciona vendedores, corresponde seller_state."),
    Rule("ordenes_entregadas", ["entregada", "entregadas", "entregado", "entregados"], [], ["olist_orders_dataset"], [],
         "\"Entregado\" es una condición sobre la orden: order_status = 'delivered' en olist_orders_dataset. Aunque la "
         "pregunta hable de transportistas, categorías o vendedores, hay que unir con la tabla de órdenes para aplicar el filtro."),
    Rule("categorias_producto", ["categoria", "categorias"], ["ticket", "tickets", "soporte", "reclamo", "reclamos"],
         ["olist_products_dataset", "product_category_name_translation"], [],
         "Las categorías de producto se devuelven en inglés cuando exista traducción, usando product_category_name_english "
         "y conservando el nombre en portugués como fallback."),
    Rule("compradores_unicos", ["comprador", "compradores", "cliente unico", "clientes unicos", "recurrente", "recurrentes",
                                "recompra"], [], ["olist_customers_dataset"], [],
         "Un comprador único se identifica por customer_unique_id, no por customer_id. Toda pregunta sobre compradores "
         "únicos, recurrencia o recompra necesita olist_customers_dataset."),
]


def plain_term(term: str) -> str:
    return strip_marks(re.sub(r"\s+", " ", term).strip()).lower()


def matching_form(x: Column) -> Column:
    return fold(clean_spaces(x))


def _any_term(folded: Column, terms: list[str]) -> Column:
    if not terms:
        return F.lit(False)
    return folded.rlike(r"(?U)\b(?:" + "|".join(re.escape(plain_term(t)) for t in terms) + r")\b")


def fired(folded: Column, rule: Rule) -> Column:
    """Whole-word match of an activation term and of no exclusion term."""
    return _any_term(folded, rule.activation) & ~_any_term(folded, rule.exclusion)


def fired_rules(folded: Column, rules: list[Rule] = RULES) -> Column:
    return F.concat(none(), *[given(fired(folded, r), [r.id]) for r in rules])


def rule_tables(folded: Column, rules: list[Rule] = RULES) -> Column:
    """Tables of the fired rules; the first alternative whose pattern occurs replaces the rule's own."""
    lists = []
    for rule in rules:
        tables = given(F.lit(True), rule.tables)
        for pattern, other in reversed(rule.alternatives):
            tables = F.when(folded.rlike(pattern), given(F.lit(True), other)).otherwise(tables)
        lists.append(F.when(fired(folded, rule), tables).otherwise(none()))
    return ordered_union(none(), *lists)


def rule_texts(folded: Column, rules: list[Rule] = RULES) -> Column:
    """The wording of the fired rules, one bullet each."""
    return F.array_join(F.concat(none(), *[given(fired(folded, r), [f"- {r.text}"]) for r in rules]), "\n")


def term_table(spark, rules: list[Rule] = RULES) -> DataFrame:
    rows = [(r.id, plain_term(t), kind) for r in rules
            for kind, terms in (("on", r.activation), ("off", r.exclusion)) for t in terms]
    items = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(t).alias("term"), F.lit(k).alias("kind")) for i, t, k in rows])
    return spark.range(1).select(F.inline(items))


def _pieces(x: Column) -> Column:
    """Words and what stands between them, in turn; joined they give the text again."""
    return F.regexp_extract_all(x, F.lit(r"(?U)\w+|[^\w]+"), F.lit(0))


def anchored(terms: DataFrame) -> DataFrame:
    """Terms with the piece they are looked up by: the word found in the fewest terms, of several the longest (marks only if there is no word).

    Adds ``anchor``, its place ``_at`` in the term and the term's number of pieces ``_size``.
    """
    listed = terms.select("term").distinct().withColumn("_p", _pieces(F.col("term"))).filter(F.size("_p") > 0)
    pieces = listed.select("term", F.size("_p").alias("_size"), F.posexplode("_p").alias("_at", "anchor"))
    often = pieces.select("term", "anchor").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("_in"))
    order = F.struct(~F.col("anchor").rlike(r"^(?U)\w"), "_in", -F.length("anchor"), "anchor", "_at")
    best = pieces.join(often, "anchor").groupBy("term", "_size").agg(F.min_by(F.struct("anchor", "_at"), order).alias("_a"))
    return terms.join(best.select("term", "_size", "_a.*"), "term")


def tag_texts(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, rule) pairs for a rule catalogue of any size.

    The pieces of a text join the terms on each term's rarest word, one light row a piece; only where that word stands is the text's own
    stretch of pieces compared with the whole term. So nothing is written out for words that no term is looked up by, however
    long the terms are. A stretch ends at word boundaries on both sides, as ``fired_rules`` asks: a mark at the start or
    end of a text has none outside.
    """
    is_word = lambda piece: piece.rlike(r"^(?U)\w")
    cut = df.select(key, _pieces(matching_form(F.col(text))).alias("_p")).select(key, F.explode(F.array("_p")).alias("_p")).filter(F.size("_p") > 0)
    size = F.size("_p")
    first = F.when(is_word(F.element_at("_p", 1)), 0).otherwise(1)
    last = F.when(is_word(F.element_at("_p", -1)), size).otherwise(size - 1)
    bounds = cut.select(key, "_p", first.alias("_first"), last.alias("_end")).filter("_first < _end")
    words = cut.select(key, F.posexplode("_p").alias("_place", "anchor"))
    start = (F.col("_place") - F.col("_at")).alias("start")
    hits = words.join(anchored(terms), "anchor").filter(start >= 0).select(key, F.struct(start, "_size", "term", "rule_id", "kind").alias("_hit"))
    listed = hits.groupBy(key).agg(F.collect_set("_hit").alias("_hits"))
    fits = lambda h: ((h["start"] >= F.col("_first")) & (h["start"] + h["_size"] <= F.col("_end"))
                      & (F.array_join(F.slice("_p", h["start"] + 1, h["_size"]), "") == h["term"]))
    found = bounds.join(listed, key).select(key, F.explode(F.filter("_hits", fits)).alias("_hit"))
    return (found.groupBy(key, F.col("_hit.rule_id").alias("rule_id"))
            .agg(F.bool_or(F.col("_hit.kind") == "on").alias("_on"), F.bool_or(F.col("_hit.kind") == "off").alias("_off"))
            .filter(F.col("_on") & ~F.col("_off")).select(key, "rule_id"))
