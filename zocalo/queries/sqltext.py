"""SQL spellings of the text forms and question rules, for the side-by-side checks."""

from __future__ import annotations

from zocalo.functions import vocabulary as v
from zocalo.operators.rules import RULES, plain_term
from zocalo.queries.views import sql_list


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def fingerprint_form(x: str) -> str:
    return clean(f"regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')")


def token(x: str) -> str:
    return f"replace({fingerprint_form(x)}, ' ', '_')"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def compare_form(x: str) -> str:
    return f"trim(regexp_replace(strip_accents({casefold(x)}), '[_\\s]+', ' ', 'g'))"


def sql_form(x: str) -> str:
    return casefold(f"trim(rtrim({clean(x)}, ';'))")


def has_any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def case(branches: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in branches) + f" ELSE {default} END"


def empty() -> str:
    return "CAST([] AS VARCHAR[])"


def given(condition: str, items: list[str]) -> str:
    return f"CASE WHEN {condition} THEN {sql_list(items)} ELSE {empty()} END"


def chain(lists: list[str]) -> str:
    return "flatten([" + ", ".join(lists) + "])"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda item, i: list_position({x}, item) = i)"


def intent(t: str) -> str:
    words = "|".join(v.TEMPORAL_WORDS)
    trend = f"({has_any(t, v.TEMPORAL_PHRASES)} OR regexp_matches({t}, '(^|\\s)({words})(\\s|$)'))"
    return case([(trend, "'temporal_trend'"), (has_any(t, v.RANKING_WORDS), "'ranking'"),
                 (has_any(t, v.COMPARISON_WORDS), "'comparison'"), (has_any(t, v.COUNT_INTENT_WORDS), "'count'"),
                 (has_any(t, v.AGGREGATION_WORDS), "'aggregation'")], "'detail'")


def operation(t: str, i: str) -> str:
    rank = f"{i} = 'ranking' AND "
    return case([(f"{i} = 'count'", "'count'"),
                 (f"contains({t}, 'promedio') AND {has_any(t, v.NEAR_WORDS)}", "'rank_nearest_average'"),
                 (f"{i} = 'comparison' OR {has_any(t, v.COMPARISON_WORDS)}", "'compare'"),
                 (rank + has_any(t, v.DESCENDING_PHRASES), "'rank_desc'"), (rank + has_any(t, v.ASCENDING_PHRASES), "'rank_asc'"),
                 (rank + has_any(t, v.HIGHEST_WORDS), "'rank_desc'"), (rank + has_any(t, v.LOWEST_WORDS), "'rank_asc'"),
                 (has_any(t, v.MEDIAN_WORDS), "'median'"), (has_any(t, v.AVERAGE_WORDS), "'average'"),
                 (has_any(t, v.COUNT_WORDS), "'count'"), (has_any(t, v.SUM_WORDS), "'sum'")], "'detail'")


def metrics(t: str) -> str:
    return chain([given(has_any(t, w), names) for w, names in v.METRIC_WORDS])


def groups(t: str) -> str:
    return chain([given(has_any(t, w), [name]) for w, name in v.GROUP_WORDS])


def filters(question: str, t: str) -> str:
    parts = []
    for code in v.STATE_CODES:
        # Word boundaries spelled out: the SQL engine's own know ASCII letters only.
        named = f"regexp_matches({question}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{v.STATE_PREFIX})\\s+{code}(?:[^\\p{{L}}\\p{{N}}_]|$)')"
        bare = f"regexp_matches({question}, '(?:^|[^\\p{{L}}\\p{{N}}_]){code}(?:[^\\p{{L}}\\p{{N}}_]|$)')"
        hit = named if code in v.AMBIGUOUS_STATE_CODES else f"({named} OR {bare})"
        parts.append((hit, "state", code))
    parts += [(has_any(t, w), field, value) for w, (field, value) in v.FILTER_WORDS]
    support = has_any(t, v.SUPPORT_WORDS)
    unresolved = has_any(t, v.UNRESOLVED_WORDS)
    parts.append((f"{support} AND {unresolved}", "resolved", "false"))
    parts.append((f"{support} AND NOT {unresolved} AND {has_any(t, v.RESOLVED_WORDS)}", "resolved", "true"))
    made = [f"CASE WHEN {c} THEN {{'field': '{f}', 'operator': '=', 'value': '{x}'}} END" for c, f, x in parts]
    return "list_filter([" + ", ".join(made) + "], lambda f: f IS NOT NULL)"


def any_of(items: str, names: list[str]) -> str:
    return f"list_has_any({items}, {sql_list(names)})"


def _context_hit(t: str, m: str, names: list[str], words: list[str]) -> str:
    return f"({any_of(m, names)}" + (f" OR {has_any(t, words)})" if words else ")")


def context(t: str, m: str) -> str:
    return chain([given(_context_hit(t, m, names, words), labels) for names, words, labels, _ in v.CONTEXT_RULES])


def tables(t: str, m: str, g: str) -> str:
    lists = [given(_context_hit(t, m, names, words), found) for names, words, _, found in v.CONTEXT_RULES]
    lists.append(given(f"list_contains({g}, 'category') AND NOT {any_of(m, v.SUPPORT_METRICS)}", v.CATEGORY_TABLES))
    lists.append(given(f"list_contains({g}, 'state')", v.STATE_TABLES))
    return chain(lists)


def filter_tables(f: str) -> str:
    lookup = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in v.FILTER_TABLES.items())
    return f"list_transform({f}, lambda x: CASE x.field {lookup} END)"


def _term(t: str, terms: list[str]) -> str:
    return "(" + (" OR ".join(f"regexp_matches({t}, '\\b{plain_term(x)}\\b')" for x in terms) or "false") + ")"


def rule_fired(t: str, rule) -> str:
    return f"({_term(t, rule.activation)} AND NOT {_term(t, rule.exclusion)})"


def rule_tables(t: str) -> str:
    lists = []
    for rule in RULES:
        body = sql_list(rule.tables)
        if rule.alternatives:
            body = "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN {sql_list(o)}" for p, o in rule.alternatives) + f" ELSE {body} END"
        lists.append(f"CASE WHEN {rule_fired(t, rule)} THEN {body} ELSE {empty()} END")
    return chain(lists)


def normalized(t: str, i: str, m: str, g: str, c: str) -> str:
    text = t
    for old, new in v.PHRASES.items():
        text = f"replace({text}, {q(old)}, {q(new)})"
    return case([(f"{i} = 'ranking' AND list_contains({m}, 'on_time_rate')", q(v.CARRIER_RANKING_FORM)),
                 (f"list_contains({m}, 'revenue') AND list_contains({g}, 'month')", q(v.MONTHLY_REVENUE_FORM)),
                 (f"list_contains({c}, 'inventario') AND list_contains({m}, 'reorder_point')", q(v.LOW_STOCK_FORM))], clean(text))
