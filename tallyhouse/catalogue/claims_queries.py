"""CL*: audit of figures in text. The texts are the documents and conversations, and notes
written by Spark from each customer's own orders (some wrong on purpose)."""

from pyspark.sql import functions as F

from tallyhouse.catalogue.check_tables import T as TABLES, dbl
from tallyhouse.catalogue.kpi_queries import CANONICAL
from tallyhouse.catalogue.registry import query
from tallyhouse.functions.kpi_text import fixed
from tallyhouse.functions.money import money
from tallyhouse.plans import claims as cl, kpis
from tallyhouse.sources.sample import PRACTICES

SCOPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *PRACTICES]


def note_parts(f):
    o = f.raw("orders").groupBy(F.col("o_custkey").alias("c")).agg(
        *[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(f"n{s.lower()}") for s in "OFP"], F.sum(money("o_totalprice")).cast("double").alias("total"))
    n = F.col("no") + F.col("nf") + F.col("np")
    return o.select("c", "no", "nf", "np", "total", n.alias("n"), (F.col("total") / 1e6).alias("m"), (n * 100.0 / 37).alias("p"))


def notes(f):
    c = F.col("c")
    lit = F.lit
    text = F.concat(
        lit("Backlog declined by "), F.col("n") + F.when(c % 3 == 0, 1).otherwise(0), lit(" invoices, distributed across Open ("), "no", lit("), Paid ("), "nf", lit("), and Partial ("), "np", lit("). "),
        F.when(c % 4 == 0, "In ASIA, DSO of ").otherwise("Firmwide DSO of "), c % 300 + 100, lit(".5 days held. Revenue reached $"), fixed(F.col("m"), 2), lit("M, a rise of "), fixed(F.col("p"), 1),
        lit("% on plan. The firm counts "), c % 200, lit(" low-utilization employees and "), c % 40, lit(" active partners, or $"), c % 900 + 1, lit("K per partner."),
        F.when(c % 5 == 0, " This slice does not carry line detail.").otherwise(""),
        lit("\n| item | value |\n| revenue | $"), fixed(F.when(c % 6 == 0, F.col("m") * 1.1).otherwise(F.col("m")), 2), lit("M |\n| growth | "), fixed(F.when(c % 7 == 0, F.col("p") + 5).otherwise(F.col("p")), 1), lit("% |"))
    return note_parts(f).select(c.alias("id"), text.alias("text"))


_fx = lambda e, d: f"CAST(CAST(round(CAST({e} AS DECIMAL(38,8)), {d}) AS DECIMAL(38,{d})) AS VARCHAR)"
TABLES["r_note_parts"] = f"""SELECT *, total / 1e6 AS m, n * 100.0::DOUBLE / 37 AS p FROM (SELECT o_custkey AS c, count(*) FILTER (o_orderstatus = 'O') AS no_, count(*) FILTER (o_orderstatus = 'F') AS nf, count(*) FILTER (o_orderstatus = 'P') AS np,
    count(*) AS n, {dbl('sum(CAST(o_totalprice AS DECIMAL(38,4)))')} AS total FROM orders GROUP BY 1)"""
TABLES["r_notes"] = f"""SELECT c AS id, 'Backlog declined by ' || (n + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) || ' invoices, distributed across Open (' || no_ || '), Paid (' || nf || '), and Partial (' || np || '). ' || CASE WHEN c % 4 = 0 THEN 'In ASIA, DSO of ' ELSE 'Firmwide DSO of ' END
    || (c % 300 + 100) || '.5 days held. Revenue reached $' || {_fx('m', 2)} || 'M, a rise of ' || {_fx('p', 1)} || '% on plan. The firm counts ' || (c % 200) || ' low-utilization employees and ' || (c % 40) || ' active partners, or $' || (c % 900 + 1) || 'K per partner.'
    || CASE WHEN c % 5 = 0 THEN ' This slice does not carry line detail.' ELSE '' END || chr(10) || '| item | value |' || chr(10) || '| revenue | $' || {_fx('CASE WHEN c % 6 = 0 THEN m * 1.1 ELSE m END', 2)} || 'M |' || chr(10) || '| growth | ' || {_fx('CASE WHEN c % 7 = 0 THEN p + 5 ELSE p END', 1)} || '% |' AS text FROM r_note_parts"""
TABLES["r_figures"] = CANONICAL


def corpus(f):
    docs = f.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    talk = f.raw("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(talk).unionByName(notes(f).select(F.concat(F.lit("n"), "id").alias("id"), "text"))


_all = "(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'n' || id, text FROM r_notes)"
_val = lambda t, p, i=1: f"TRY_CAST(replace(regexp_extract({t}, '{p}', {i}), ',', '') AS DOUBLE)"
_m, _p = r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KMBkmb]?)\b", r"([0-9]+(?:\.[0-9]+)?)\s*(%|pp\b)"
_d, _n = r"([0-9]+(?:\.[0-9]+)?)\s*days?\b", r"([0-9][0-9,]*)\s+(?:low[- ]utili[sz]ation\s+|active\s+)?(?:employees|headcount|partners?|engagements?|clients?|invoices?|projects?)\b"
_tok = lambda p: f"SELECT id, unnest(regexp_extract_all(text, '{p}')) AS raw FROM {_all}"
_unit = f"CASE upper(regexp_extract(raw, '{_m}', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END"
query("CL1_claims", f"""SELECT * FROM (SELECT id, 'dollar' AS kind, raw, {_val('raw', _m)} * {_unit} AS value FROM ({_tok(_m)}) UNION ALL SELECT id, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' ELSE 'points' END, raw, {_val('raw', _p)} FROM ({_tok(_p)})
    UNION ALL SELECT id, 'days', raw, {_val('raw', _d)} FROM ({_tok(_d)}) UNION ALL SELECT id, 'count', raw, {_val('raw', _n)} FROM ({_tok(_n)})) WHERE value IS NOT NULL""")(lambda f: cl.extract_claims(corpus(f)))
_i = lambda p: "(?i)" + p.replace("'", "''")
_change, _part = _i(cl.CHANGE_WITH_PARTS), cl.PART
_parts = f"list_transform(regexp_extract_all(regexp_extract(snippet, '{_change}', 2), '{_part}', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))"
_sum_parts = f"""SELECT id, stated, CAST(list_sum(parts) AS BIGINT) AS total, 'stated ' || stated || ', parts sum to ' || CAST(list_sum(parts) AS BIGINT) AS message
    FROM (SELECT id, CAST(replace(regexp_extract(snippet, '{_change}', 1), ',', '') AS BIGINT) AS stated, {_parts} AS parts FROM (SELECT id, unnest(regexp_extract_all(text, '{_change}')) AS snippet FROM {_all})) WHERE len(parts) > 0 AND stated <> list_sum(parts)"""
query("CL2_parts_mismatch", _sum_parts)(lambda f: cl.parts_mismatch(corpus(f)).select("id", "stated", "total", "message"))
_fig = lambda n: f"(SELECT value FROM r_figures WHERE name = '{n}')"
_subset = " UNION ALL ".join(f"SELECT id, '{name}' AS name, value FROM (SELECT id, TRY_CAST(replace(unnest(regexp_extract_all(text, '{_i(p)}', 1)), ',', '') AS DOUBLE) AS value FROM {_all}) WHERE {_fig(name)} > 0 AND value > {_fig(name)}" for name, p in cl.SUBSETS.items())
query("CL3_subset_exceeds_total", _subset)(lambda f: cl.subset_exceeds_total(corpus(f), kpis.canonical_totals(f)).select("id", "name", "value"))
_per = _i(cl.PER_UNIT)
_scale = f"""SELECT id, x.name, x.value FROM (SELECT id, 'revenue_per_' || lower(regexp_extract(raw, '{_per}', 3)) AS name, TRY_CAST(replace(regexp_extract(raw, '{_per}', 1), ',', '') AS DOUBLE)
    * CASE upper(regexp_extract(raw, '{_per}', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END AS value FROM (SELECT id, unnest(regexp_extract_all(text, '{_per}')) AS raw FROM {_all})) x
    JOIN r_figures g ON x.name = g.name WHERE x.value > 0 AND g.value > 0 AND (x.value / g.value < 0.1 OR x.value / g.value > 10)"""
query("CL4_scale_mismatch", _scale)(lambda f: cl.scale_mismatch(corpus(f), kpis.canonical_totals(f)).select("id", "name", "value"))
_days = _i(cl.NAMED_DAYS)
_at = "coalesce(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(tokens[1:i], lambda t: length(t))), 0)"
_drift = f"""SELECT id, 'dso' AS name, value FROM (SELECT id, TRY_CAST(replace(regexp_extract(tokens[i + 1], '{_days}', 1), ',', '') AS DOUBLE) AS value,
    substring(text, greatest(pos - 80, 0) + 1, pos - greatest(pos - 80, 0)) || tokens[i + 1] || substring(text, pos + length(tokens[i + 1]) + 1, 80) AS around
    FROM (SELECT *, CAST({_at} AS BIGINT) AS pos FROM (SELECT *, unnest(range(len(tokens))) AS i FROM (SELECT id, text, regexp_extract_all(text, '{_days}') AS tokens, string_split_regex(text, '{_days}') AS gaps FROM {_all}))))
    WHERE NOT regexp_matches(around, '{cl.SCOPE}') AND {' AND '.join(f"NOT contains(around, '{s}')" for s in SCOPES)} AND {_fig('dso')} > 0 AND abs(value - {_fig('dso')}) / {_fig('dso')} > 0.02"""
query("CL5_kpi_drift", _drift)(lambda f: cl.kpi_drift(corpus(f), kpis.canonical_totals(f), SCOPES).select("id", "name", "value"))
_mv, _cv = f"CAST({_fx('m', 2)} AS DOUBLE) * 1e6", f"CAST({_fx('CASE WHEN c % 6 = 0 THEN m * 1.1 ELSE m END', 2)} AS DOUBLE) * 1e6"
_kv = "CAST((c % 900 + 1) * 1000 AS DOUBLE)"
_near = lambda a, b: f"({a} > 0 AND {b} > 0 AND (abs({a} - {b}) / greatest({a}, {b}) <= 0.005 OR ({a} < 100000 AND abs({a} - {b}) <= 1000)))"
_pv, _qv = f"CAST({_fx('p', 1)} AS DOUBLE)", f"CAST({_fx('CASE WHEN c % 7 = 0 THEN p + 5 ELSE p END', 1)} AS DOUBLE)"
_line = r"^\s*\|.+\|\s*$"
_figs = lambda t: f"""SELECT rid, id, 'dollar' AS kind, raw, {_val('raw', _m)} * {_unit} AS value FROM (SELECT rid, id, unnest(regexp_extract_all({t}, '{_m}')) AS raw FROM x_t)
    UNION ALL SELECT rid, id, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' ELSE 'points' END, raw, {_val('raw', _p)} FROM (SELECT rid, id, unnest(regexp_extract_all({t}, '{_p}')) AS raw FROM x_t)"""
query("CL6_not_in_table", f"""WITH x_t AS (SELECT row_number() OVER () AS rid, id, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '{_line}')), chr(10)) AS cells, array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{_line}')), chr(10)) AS body
        FROM (SELECT id, string_split_regex(text, '\\r?\\n') AS lines FROM {_all})),
    x_c AS ({_figs('cells')}), x_q AS ({_figs('body')})
    SELECT DISTINCT ON (q.rid, q.kind, q.value) q.id, q.kind, q.value FROM x_q q JOIN x_t t ON t.rid = q.rid WHERE trim(t.cells) <> '' AND q.value IS NOT NULL
    AND CASE WHEN q.kind = 'dollar' THEN q.value >= 1000 ELSE NOT (q.value = 0 OR q.value = 100 OR (q.value = floor(q.value) AND q.value < 10)) END
    AND NOT EXISTS (SELECT 1 FROM x_c c WHERE c.rid = q.rid AND c.kind = q.kind AND CASE WHEN q.kind = 'dollar' THEN {_near('q.value', 'c.value')} ELSE abs(q.value - c.value) <= 0.1 END)""")(lambda f: cl.not_in_table(corpus(f)).select("id", "kind", "value"))
query("CL7_data_gap_language", "SELECT 'n' || c AS id, 'This slice does not carry' AS snippet FROM r_note_parts WHERE c % 5 = 0")(lambda f: cl.data_gap_language(corpus(f)).select("id", "snippet"))
_names = ["low_utilization_employees", "partners", "revenue_per_partner", "dso"]


def stated(f):
    """Every customer note states the firm figures, each off by up to four percent."""
    people = f.raw("customer").select(F.col("c_custkey").alias("id"))
    return people.join(F.broadcast(kpis.canonical_totals(f)), F.lit(True)).select("id", "name", (F.col("value") * (F.lit(1.0) + (F.col("id") % 9 - 4) / 100.0)).alias("value"), F.lit("count").alias("unit"))


query("CL8_tolerance_by_kind", "SELECT c_custkey AS id, 'kpi_drift' AS type, name, value * (1.0::DOUBLE + (c_custkey % 9 - 4) / 100.0::DOUBLE) AS claimed, value AS firm_value FROM customer, r_figures WHERE abs(value * (1.0::DOUBLE + (c_custkey % 9 - 4) / 100.0::DOUBLE) - value) / abs(value) > 0.02")(
    lambda f: cl.claim_drift(stated(f), kpis.canonical_totals(f)))


def pairs(f):
    c, m = F.col("c"), F.col("m")
    return note_parts(f).select(
        c.alias("id"), F.concat(F.lit("Why is revenue $"), fixed(m, 2), F.lit("M when growth is "), fixed(F.col("p") + F.when(c % 7 == 0, 5).otherwise(0), 1), F.lit("% and not 5%?")).alias("question"),
        F.concat(F.lit("Revenue is $"), fixed(m * F.when(c % 6 == 0, 1100).otherwise(1000), 0), F.lit("K; growth is "), fixed(F.col("p"), 1), F.lit("%.")).alias("answer"))


_av = f"CAST({_fx('m * CASE WHEN c % 6 = 0 THEN 1100 ELSE 1000 END', 0)} AS DOUBLE) * 1e3"
_gv = f"CAST({_fx('p + CASE WHEN c % 7 = 0 THEN 5 ELSE 0 END', 1)} AS DOUBLE)"
_bad1 = f"({_mv} >= 1000 AND NOT ({_mv} > 0 AND {_av} > 0 AND (abs({_mv} - {_av}) / greatest({_mv}, {_av}) <= 0.02 OR (greatest({_mv}, {_av}) < 100000 AND abs({_mv} - {_av}) <= 500))))"
_bad2 = f"(NOT ({_gv} = 0 OR {_gv} = 100 OR ({_gv} = floor({_gv}) AND {_gv} < 10)) AND abs({_gv} - {_pv}) > 0.1)"
query("CL9_supported_numbers", f"SELECT c AS id, NOT ({_bad1} OR {_bad2}) AS supported, concat_ws('; ', CASE WHEN {_bad1} THEN '$' || {_fx('m', 2)} || 'M' END, CASE WHEN {_bad2} THEN {_fx('p + CASE WHEN c % 7 = 0 THEN 5 ELSE 0 END', 1)} || '%' END) AS unsupported FROM r_note_parts")(
    lambda f: cl.unsupported_numbers(pairs(f)))


def stored_rows(f):
    c = F.col("c")
    told = F.array(F.struct(F.concat(F.lit("first "), "no").alias("narrative")), F.struct(F.when(c % 2 == 0, F.concat(F.lit("second "), "nf")).alias("narrative")))
    return note_parts(f).select(
        F.lit("admin").alias("persona"), F.when(c % 3 == 0, "insight").when(c % 3 == 1, "bottom_chip").otherwise("followup").alias("slot_type"), c.alias("slot_id"), F.concat(F.lit("Head "), c).alias("headline"),
        F.when(c % 5 != 0, F.concat(F.lit("$"), "n")).alias("value"), F.lit("").alias("narrative"), F.when(c % 3 != 2, F.to_json(F.struct(told.alias("sub_question_results")))).alias("cached_agent_payload"))


_told = "concat_ws(chr(10) || chr(10), {own} 'first ' || no_, CASE WHEN c % 2 = 0 THEN 'second ' || nf END)"
_own = "'Head ' || c, CASE WHEN c % 5 <> 0 THEN '$' || n END,"
query("CL10_gather_prose", f"SELECT 'admin' AS persona, CASE WHEN c % 3 = 0 THEN 'insight' ELSE 'bottom_chip' END AS slot_type, c AS slot_id, CASE WHEN c % 3 = 0 THEN {_told.format(own=_own)} ELSE {_told.format(own='')} END AS text FROM r_note_parts WHERE c % 3 <> 2")(lambda f: cl.gather_prose(stored_rows(f)))
query("CL_audit_by_type", " UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM ({q}) HAVING count(*) > 0" for t, q in (
    ("sum_of_parts_mismatch", _sum_parts), ("subset_exceeds_total", _subset), ("scale_mismatch", _scale), ("kpi_drift", _drift))))(
    lambda f: cl.audit(corpus(f), kpis.canonical_totals(f), SCOPES).groupBy("type").agg(F.count(F.lit(1)).alias("n")))
