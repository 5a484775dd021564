"""PM*, IN*: profiling, schema mapping and the insight store."""

from pyspark.sql import functions as F

from tallyhouse.catalogue.check_tables import ASOF, back, clean_open, dbl, div, pct, rnd
from tallyhouse.catalogue.claims_queries import _fx
from tallyhouse.catalogue.kpi_queries import _econ, _exp, _five, _idle, _fm, _mean, _od, _low, _partners, _rev, _win, at as month_sum, chg
from tallyhouse.catalogue.registry import query
from tallyhouse.operators.filters import compound_key, slice_of
from tallyhouse.catalogue.row_queries import scratch
from tallyhouse.plans import insights as ins, mapping as mp, profiling as pm

# profiling -----------------------------------------------------------------------
_TYPES = {"account_id": "bigint", "account_name": "string", "industry": "string", "account_type": "string", "parent_account_id": "bigint", "account_status": "string", "annual_revenue": "decimal(18,4)",
          "region": "string", "location": "string", "practice_area": "string", "customer": "string", "last_modified_date": "date"}


def _profile_sql(table, columns, types, source, k=3):
    cell = lambda c: f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)" if types[c].startswith("decimal") else f"CAST({c} AS VARCHAR)"
    return " UNION ALL ".join(f"""SELECT '{source}' AS source, '{table}' AS table_name, '{c}' AS column_name, '{types[c]}' AS type, {rnd(div(f'count(*) - count({c})', 'count(*)'), 4)} AS null_pct, count(DISTINCT {c}) AS distinct_count,
    coalesce((SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT {cell(c)} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {k})), '') AS sample_values FROM {table}""" for c in columns)


_acc = _profile_sql("r_accounts", _TYPES, _TYPES, "crm")
query("PM1_profile", _acc)(lambda f: pm.profile(f.source_table("sfdc_accounts"), "r_accounts", 3, "crm"))
_ctypes = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"}
_pool = _acc + " UNION ALL " + _profile_sql("customer", _ctypes, _ctypes, "erp")


def _pooled(f):
    return pm.pooled_profile({("crm", "r_accounts"): f.source_table("sfdc_accounts"), ("erp", "customer"): f.raw("customer").select(*_ctypes)}, 3)


query("PM2_pooled_profile", _pool)(_pooled)
query("PM3_descriptor", f"SELECT table_name, column_name, concat_ws(' | ', 'table=' || table_name, 'column=' || column_name, 'type=' || type, CASE WHEN sample_values <> '' THEN 'samples: ' || sample_values END) AS text FROM ({_pool})")(
    lambda f: _pooled(f).select("table_name", "column_name", pm.descriptor().alias("text")))

_NAME = "'field_' || (vec_id % 12) || '_' || CASE vec_id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'code' ELSE 'date_value' END"


def vectors(f):
    v = F.col("vec_id")
    tail = F.when(v % 3 == 0, "value").when(v % 3 == 1, "code").otherwise("date_value")
    return f.raw("embeddings").select(v.alias("candidate"), F.concat(F.lit("field_"), v % 12, F.lit("_"), tail).alias("name"), F.col("embedding").alias("vector"), "label")


def targets(f):
    """The first vector of every label, under a name of its own."""
    first = f.raw("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.col("label").alias("target"), F.concat(F.lit("field_"), "label", F.lit("_value")).alias("name"), "vector")


_T = "(SELECT label AS target, 'field_' || label || '_value' AS tname, arg_min(embedding, vec_id)::DOUBLE[] AS tv FROM embeddings GROUP BY 1)"
_jac = lambda a, c: f"CASE WHEN lower({a}) = lower({c}) THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(string_split({a}, '_'), string_split({c}, '_'))) AS DOUBLE) / len(list_distinct(list_concat(string_split({a}, '_'), string_split({c}, '_')))) END"
query("PM4_cosine", f"SELECT target, vec_id AS candidate, {rnd('list_cosine_similarity(embedding::DOUBLE[], tv)', 6)} AS cosine FROM embeddings, {_T}")(
    lambda f: mp.pair_scores(targets(f), vectors(f)).select("target", "candidate", F.round(F.col("score").cast("decimal(38,8)"), 6).cast("double").alias("cosine")))
query("PM5_name_similarity", f"SELECT target, vec_id AS candidate, {_jac(_NAME, 'tname')} AS similarity FROM embeddings, {_T}")(
    lambda f: mp.pair_scores(targets(f), vectors(f)).select("target", "candidate", "similarity"))
_best = f"""SELECT target, candidate, score, blended, CAST(row_number() OVER (PARTITION BY target ORDER BY blended DESC, candidate) AS INTEGER) AS rank FROM (SELECT target, vec_id AS candidate, list_cosine_similarity(embedding::DOUBLE[], tv) AS score,
    list_cosine_similarity(embedding::DOUBLE[], tv) + 0.4::DOUBLE * ({_jac(_NAME, 'tname')}) AS blended FROM embeddings, {_T})"""
query("PM6_best_candidates", f"SELECT target, candidate, {rnd('score', 4)} AS score, rank FROM ({_best}) WHERE rank <= 5")(
    lambda f: mp.best_candidates(targets(f), vectors(f)).select("target", "candidate", F.round(F.col("score").cast("decimal(38,8)"), 4).cast("double").alias("score"), "rank"))
HIGH, MEDIUM = 0.55, 0.35


def _matches(f):
    m = mp.best_candidates(targets(f), vectors(f))
    c = F.col("candidate")
    return m.select((F.col("target") % 3).alias("table_name"), "target", "rank", "blended", F.concat(F.lit("src"), c % 2).alias("source_table"), F.concat(F.lit("col"), c % 4).alias("source_column"))


_mt = f"""SELECT target % 3 AS table_name, target, rank, blended, 'src' || (candidate % 2) AS source_table, 'col' || (candidate % 4) AS source_column FROM ({_best}) WHERE rank <= 5"""
_lvl = f"CASE WHEN blended >= {HIGH} THEN 2 WHEN blended >= {MEDIUM} THEN 1 ELSE 0 END"
_DECIDED = f"""SELECT table_name, target, main_source, source_table, source_column, list_extract(['low', 'medium', 'high'], lvl + 1) AS confidence, list_extract(['low', 'medium', 'high'], tl + 1) AS table_confidence, CASE WHEN source_table <> main_source THEN 'review: different table'
    WHEN EXISTS (SELECT 1 FROM ({_mt}) m WHERE m.rank > 1 AND m.target = x_b.target AND m.source_column = x_b.source_column AND m.source_table <> x_b.source_table) THEN 'confirm source' WHEN lvl < 2 THEN 'review: low confidence' ELSE 'mapped' END AS status
    FROM (SELECT *, {_lvl} AS lvl, first_value(source_table) OVER (PARTITION BY table_name ORDER BY target) AS main_source, min({_lvl}) OVER (PARTITION BY table_name) AS tl FROM ({_mt}) WHERE rank = 1) x_b"""
query("PM7_decisions", _DECIDED)(lambda f: mp.decide(_matches(f), HIGH, MEDIUM))

# views from mapping rows -----------------------------------------------------------
_ROWS = "table_name string, target bigint, position bigint, column_name string, type string"
_TOLD = "table_name string, target bigint, source_table string, source_column string, expression string"
_JOINS = "table_name string, alias string, source_table string, on string, how string"
_INVOICE = [("invoice_id", "bigint"), ("customer_name", "string"), ("location", "string"), ("amount", "decimal(18,4)"), ("due_date", "date"), ("department", "string"), ("owner", "string")]
_ANSWERS = {"customer_name": ("customer", "c_name", None), "location": ("nation", "n_name", None), "amount": (None, None, "cast(main.o_totalprice as decimal(18,4))"),
            "due_date": (None, None, "date_add(cast(main.o_orderdate as date), 30)"), "department": (None, None, "'HR'"), "owner": (None, None, "'none'")}


def _invoices(f, answers, allow_gaps=False):
    """An invoice view from orders, customers and nations; ``answers`` are the reviews."""
    t, make = "invoices", f.spark.createDataFrame
    required = make([(t, i, i, c, kind) for i, (c, kind) in enumerate(_INVOICE)], _ROWS)
    decided = make([(t, 0, "orders", "orders", "o_orderkey", mp.MAPPED)], "table_name string, target bigint, main_source string, source_table string, source_column string, status string")
    reviews = make([(t, [c for c, _ in _INVOICE].index(c), *how) for c, how in answers.items()], _TOLD)
    joins = make([(t, "c", "customer", "main.o_custkey = c.c_custkey", "left"), (t, "n", "nation", "c.c_nationkey = n.n_nationkey", "left")], _JOINS)
    return mp.compiled(t, mp.mapping_rows(required, decided, reviews), joins, {n: f.raw(n) for n in ("orders", "customer", "nation")}, allow_gaps)


query("PM8_mapped_view", f"SELECT o_orderkey AS invoice_id, c_name AS customer_name, n_name AS location, {dbl('CAST(o_totalprice AS DECIMAL(18,4))')} AS amount, CAST(o_orderdate AS DATE) + 30 AS due_date, 'HR' AS department, 'none' AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")(
    lambda f: _invoices(f, _ANSWERS))
query("PM9_gaps_allowed", f"SELECT n_name AS location, count(*) AS n, 0 AS with_department, 0 AS with_owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(
    lambda f: _invoices(f, {c: how for c, how in _ANSWERS.items() if c != "department"} | {"owner": ("staff", "owner", None)}, allow_gaps=True)
    .groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.count("department").alias("with_department"), F.count("owner").alias("with_owner")))


def _required(f):
    """Three required tables: a column for each label, and one more that nothing was matched to."""
    labels = f.raw("embeddings").select(F.col("label").cast("bigint").alias("target")).distinct()
    rows = labels.unionByName(labels.where("target < 3").select((F.col("target") + 100).alias("target")))
    t = F.col("target")
    return rows.select(F.when(t < 100, t % 3).otherwise(t - 100).alias("table_name"), "target", t.alias("position"), F.concat(F.lit("field_"), t).alias("column_name"), F.when(t % 4 == 1, "bigint").otherwise("string").alias("type"))


def _reviewed(f):
    """People have answered for some columns: an expression, or a column of the second source."""
    r, t = _required(f).where("target < 100 and target % 5 in (1, 2)"), F.col("target")
    return r.select("table_name", "target", F.when(t % 5 == 2, "src1").alias("source_table"), F.when(t % 5 == 2, "col1").alias("source_column"), F.when(t % 5 == 1, "main.col0 * 2").alias("expression"))


def _mapping(f):
    """Mapping rows from the stored decisions, the reviews, and the joins of the first two tables."""
    path = scratch(f, "decisions")
    mp.decide(_matches(f), HIGH, MEDIUM).write.parquet(path)
    rows = mp.mapping_rows(_required(f), f.spark.read.parquet(path), _reviewed(f))
    joins = [(t, "other", s, on, "left") for t in (0, 1) for s, on in (("src1", "main.col1 = other.col0"), ("src0", "main.col0 = other.col1"))]
    return rows, f.spark.createDataFrame(joins, _JOINS.replace("table_name string", "table_name bigint"))


def _sources(f):
    names = lambda df, *columns: df.select(*[F.col(c).alias(f"col{i}") for i, c in enumerate(columns)])
    return {"src0": names(f.raw("orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "src1": names(f.raw("customer"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment")}


_S0 = "(SELECT o_orderkey AS col0, o_custkey AS col1, o_orderstatus AS col2, o_orderpriority AS col3 FROM orders)"
_S1 = "(SELECT c_custkey AS col0, c_name AS col1, c_nationkey AS col2, c_mktsegment AS col3 FROM customer)"


def _field(target, main, joined):
    kind = "BIGINT" if target % 4 == 1 else "VARCHAR"
    if target < 100 and target % 5 == 1:
        value = f"TRY_CAST(main.col0 * 2 AS {kind})"
    elif target < 100 and target % 5 == 2:
        value = f"TRY_CAST({'main' if main == 'src1' else 'other'}.col1 AS {kind})" if main == "src1" or joined else f"CAST(NULL AS {kind})"
    else:
        cases = " ".join(f"WHEN 'col{i}' THEN TRY_CAST(main.col{i} AS {kind})" for i in range(4))
        value = f"CASE (SELECT source_column FROM x_d WHERE target = {target} AND status = 'mapped') {cases} END"
    return f"{value} AS field_{target}"


def _view_sql(table, fields, joined):
    parts = []
    for main, a, b, on in (("src0", _S0, _S1, "main.col1 = other.col0"), ("src1", _S1, _S0, "main.col0 = other.col1")):
        other = f"LEFT JOIN {b} other ON {on}" if joined else ""
        parts.append(f"SELECT {', '.join(_field(t, main, joined) for t in fields)} FROM {a} main {other} WHERE (SELECT any_value(main_source) FROM x_d WHERE table_name = {table}) = '{main}'")
    return f"WITH x_d AS ({_DECIDED}) {' UNION ALL '.join(parts)}"


for _table, _fields in ((0, (0, 3, 6, 9, 100)), (1, (1, 4, 7, 101)), (2, (2, 5, 8, 102))):
    query(f"PM8_view_from_decisions_{_table}", _view_sql(_table, _fields, _table < 2))(lambda f, t=_table: mp.compiled(t, *_mapping(f), _sources(f), allow_gaps=True))
query("PM9_refused_columns", f"""WITH x_d AS ({_DECIDED}), x_m AS (SELECT table_name, any_value(main_source) AS main FROM x_d GROUP BY 1), x_r AS (SELECT DISTINCT label AS t FROM embeddings UNION ALL SELECT DISTINCT label + 100 FROM embeddings WHERE label < 3)
    SELECT * FROM (SELECT tn AS table_name, 'field_' || t AS column_name, CASE WHEN told THEN 'reviewed' ELSE coalesce(status, 'no source found') END AS status,
        CASE WHEN NOT told AND source_column IS NULL THEN 'no source' WHEN NOT told AND status <> 'mapped' THEN 'open: ' || status WHEN told AND t % 5 = 2 AND main <> 'src1' AND tn = 2 THEN 'source is not joined' END AS reason
        FROM (SELECT t, CASE WHEN t < 100 THEN t % 3 ELSE t - 100 END AS tn, t < 100 AND t % 5 IN (1, 2) AS told FROM x_r) LEFT JOIN x_d ON target = t JOIN x_m ON x_m.table_name = tn) WHERE reason IS NOT NULL""")(
    lambda f: mp.refused(*_mapping(f)))

# required columns ------------------------------------------------------------------
_HAVE = {  # the check's tables, and what a column is called there if not by its own name; columns that the sample does not offer are None
    "sfdc_accounts": ("r_accounts", {}), "sfdc_engagements": ("(SELECT r_engagements.*, price AS budget_amount, CASE WHEN engagement_id % 19 <> 0 THEN price END AS forecasted_revenue, engagement_id AS contract_id, start_date AS last_modified_date FROM r_engagements)", {}),
    "sfdc_contracts": ("(SELECT o_orderkey AS contract_id, o_totalprice AS total_contract_value FROM orders WHERE o_orderkey % 13 <> 0)", {}), "workday_employees": ("r_people", {}),
    "workday_organizations": ("(SELECT n_nationkey AS cost_center, n_name AS organization_name FROM nation, range(2))", {}),
    "workday_assignments": ("(SELECT l_orderkey AS project_id, l_suppkey AS employee_id, l_linestatus AS assignment_status, l_quantity AS allocation_percentage FROM lineitem)", {}),
    "workday_timecards": ("(SELECT *, bill_rate AS billing_rate FROM r_cards)", {"week_ending_date": None}), "workday_billing_rates": ("r_billing_rates", {"billing_rate": "rate", "effective_date": "eff", "end_date": "fin"}),
    "workday_cost_rates": ("r_cost_rates", {"hourly_cost_rate": "rate", "effective_date": "eff", "end_date": "fin"}),
    "concur_expense_items": ("""(SELECT line_id AS expense_id, l_orderkey AS report_id, ship_date AS transaction_date, 'x' AS expense_type, r_lines.price * tax AS transaction_amount, true AS is_billable, s_name AS vendor_name, true AS has_receipt,
        CASE WHEN l_linenumber <> 5 THEN l_orderkey END AS project_id, region, location, practice_area, industry, customer FROM r_lines JOIN r_orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R')""", {"transaction_currency": None}),
    "concur_expense_reports": ("(SELECT o_orderkey AS report_id, o_custkey AS employee_id, 'x' AS approval_status, o_orderkey AS cost_center FROM orders)", {}),
    "cost_center_mapping": ("(SELECT n_nationkey AS cost_center_code, n_name AS department_category FROM nation)", {}),
    "sap_accounts_payable": ("""(SELECT line_id AS invoice_id, s_name AS vendor_name, ship_date AS invoice_date, ship_date AS due_date, price AS amount, 'x' AS payment_status, CASE WHEN l_linestatus = 'F' THEN ship_date END AS payment_date, 'x' AS department, region, location,
        practice_area, industry, customer FROM r_lines JOIN r_staff ON l_suppkey = s_suppkey)""", {"invoice_number": None, "currency": None}),
    "sap_accounts_receivable": ("r_invoices", {"invoice_number": None, "currency": None}),
    "sap_general_ledger": ("(SELECT 'x' AS account_type, o_totalprice AS debit_amount, o_totalprice AS credit_amount FROM orders, range(2))", {}),
}


def _filled(t):
    source, names = _HAVE[t]
    columns = pm.REQUIRED[t]
    there = {c: names.get(c, c) for c in columns}
    return f"""SELECT '{t}' AS table_name, unnest({columns}) AS column_name, unnest([{', '.join('true' if there[c] else 'false' for c in columns)}]) AS present,
        unnest([{', '.join(f'count({there[c]})' if there[c] else '0' for c in columns)}]) AS filled, count(*) AS row_count FROM {source}"""


query("PM10_required_columns", " UNION ALL ".join(map(_filled, pm.REQUIRED)))(lambda f: pm.required_columns({t: f.source_table(t) for t in pm.REQUIRED}))
query("PM10b_missing_columns", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {pm.REQUIRED[t].index(c)}, '{c}')" for t, (_, names) in _HAVE.items() for c, source in names.items() if source is None) + ") AS v(table_name, position, column_name)")(
    lambda f: pm.missing_columns({t: f.source_table(t) for t in pm.REQUIRED}).select("table_name", "position", "column_name"))

# insight store -------------------------------------------------------------------
_B, _M = lambda e: f"'$' || {_fx(e, 2)} || 'B'", lambda e: f"'$' || {_fx(e, 2)} || 'M'"
_PC, _DY = lambda e: f"{_fx(e, 2)} || '%'", lambda e: f"{_fx(e, 1)} || ' days'"
_CT = lambda noun: lambda e: f"format('{{:,}}', CAST({e} AS BIGINT)) || ' {noun}'"


def _ins(persona, slot, headline, source, v, p, text, up):
    good, bad = ("green", "red") if up else ("red", "green")
    tail = f"'was ' || {text('p')}, CASE WHEN v > p THEN 'up' WHEN v < p THEN 'down' WHEN v = p THEN 'flat' END, CASE WHEN v > p THEN '{good}' WHEN v < p THEN '{bad}' WHEN v = p THEN 'amber' END" if p else "NULL, NULL, NULL"
    return f"SELECT '{persona}' AS persona, 'insight' AS slot_type, {slot} AS slot_id, '{headline}' AS headline, {text('v')} AS value, {tail.replace(', CASE', ' AS comparison, CASE', 1) if p else 'NULL AS comparison, NULL AS trend_direction, NULL AS status_color'} FROM (SELECT {v} AS v, {p or 'NULL'} AS p FROM {source})"


_dso2 = f"(SELECT list(d ORDER BY s DESC) AS l FROM (SELECT snapshot_date AS s, {rnd(div('sum(open_ar_balance * CAST(weighted_dso_days AS DECIMAL(10,1)))', 'sum(open_ar_balance)'), 1)} AS d FROM r_snap GROUP BY 1))"
_top = lambda t, party, a: f"(SELECT {rnd(dbl(f'sum({a})') + ' / 1e6', 2)} AS t FROM {t} WHERE {clean_open()} GROUP BY {party} ORDER BY sum({a}) DESC, {party} LIMIT 1)"
INSIGHTS = " UNION ALL ".join([
    _ins("admin", 0, "Revenue", _rev(""), f"{dbl('rev')} * 12 / 1e9", None, _B, True), _ins("admin", 1, "Project margin", _win("actual_margin", ""), pct("m1", "r1"), pct("m0", "r0"), _PC, True),
    _ins("admin", 2, "Revenue per partner", _econ(""), "c / 1e6", "y / 1e6", _M, True), _ins("admin", 3, "Expenses", _exp(""), f"{dbl('e')} / 1e6", f"{dbl('bud')} / 1e6", _M, False),
    _ins("finance", 0, "DSO", _dso2, "l[1]", "l[2]", _DY, False), _ins("finance", 1, "DPO", "r_ap", _mean(_od), _mean(f"(CASE WHEN {_od} > 30 THEN {_od} - 30 END)"), _DY, True),
    _ins("finance", 2, "Top unpaid client", _top("r_ar", "customer_name", "amount"), "t", None, _M, False), _ins("finance", 3, "Top unpaid vendor", _top("r_payables", "vendor_name", "amount_due"), "t", None, _M, False),
    _ins("hr", 0, "Utilization", "r_ent", pct(month_sum("billable_hours", 1), month_sum("total_hours", 1)), pct(month_sum("billable_hours", 2), month_sum("total_hours", 2)), _PC, True),
    _ins("hr", 1, "Partners", _partners(""), "n1", "n30", _CT("partners"), True), _ins("hr", 2, "Bench cost", "r_timecards", f"{dbl(month_sum(_idle, 1, _fm))} / 1e6", f"{dbl(month_sum(_idle, 2, _fm))} / 1e6", _M, False),
    _ins("hr", 3, "Low utilization", f"(SELECT (SELECT count(*) FROM {_low(1)}) AS a, (SELECT count(*) FROM {_low(2)}) AS b)", "a", "b", _CT("employees"), False)])
query("IN1_kpi_insights", INSIGHTS.replace("WHEN v = p THEN 'flat' END, CASE", "WHEN v = p THEN 'flat' END AS trend_direction, CASE").replace("WHEN v = p THEN 'amber' END FROM", "WHEN v = p THEN 'amber' END AS status_color FROM"))(lambda f: ins.kpi_insights(f))


def slices(f):
    """Rows of every region and the whole firm, for the finance persona; places have none and fall back."""
    p = f.table("regional_pnl").groupBy("region", "fiscal_year").agg(F.sum("total_revenue").cast("double").alias("value"))
    row = lambda axis, val: [F.lit("finance").alias("persona"), axis.alias("filter_axis"), val.alias("filter_value"), F.col("fiscal_year").alias("slot_id"), "value"]
    firm = f.table("regional_pnl").groupBy("fiscal_year").agg(F.sum("total_revenue").cast("double").alias("value"))
    return p.select(*row(F.lit("region"), F.col("region"))).unionByName(firm.select(*row(F.lit("firmwide"), F.lit("all"))))


_sl = f"(SELECT 'region' AS axis, region AS val, fiscal_year AS slot_id, {dbl('sum(total_revenue)')} AS value FROM r_pnl GROUP BY 2, 3 UNION ALL SELECT 'firmwide', 'all', fiscal_year, {dbl('sum(total_revenue)')} FROM r_pnl GROUP BY 3)"
query("IN2_lookup_with_fallback", f"SELECT c_custkey AS request_id, 'finance' AS persona, axis AS filter_axis, val AS filter_value, slot_id, value FROM r_geo JOIN {_sl} ON CASE WHEN c_custkey % 2 = 1 THEN axis = 'firmwide' ELSE axis = 'region' AND val = region END")(
    lambda f: ins.lookup(f.source.customers().select(F.col("c_custkey").alias("request_id"), F.lit("finance").alias("persona"), F.when(F.col("c_custkey") % 2 == 1, "location").otherwise("region").alias("filter_axis"), F.when(F.col("c_custkey") % 2 == 1, F.col("location")).otherwise(F.col("region")).alias("filter_value")), slices(f)))


def asked(f):
    k = F.col("c_custkey")
    return f.source.customers().select(k, F.when(k % 2 == 0, F.col("region")).when(k % 4 == 1, "All").otherwise("").alias("region"), F.when(k % 3 == 0, F.col("location")).alias("location"), F.when(k % 5 == 0, F.col("industry")).otherwise("all").alias("industry"))


_ask = "(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN region WHEN c_custkey % 4 = 1 THEN 'All' ELSE '' END AS region, CASE WHEN c_custkey % 3 = 0 THEN location END AS location, CASE WHEN c_custkey % 5 = 0 THEN industry ELSE 'all' END AS industry FROM r_geo)"
query("IN3_filter_to_slice", f"SELECT c_custkey, CASE WHEN region NOT IN ('', 'All') THEN 'region' WHEN location IS NOT NULL THEN 'location' WHEN industry <> 'all' THEN 'industry' ELSE 'firmwide' END AS filter_axis, CASE WHEN region NOT IN ('', 'All') THEN region WHEN location IS NOT NULL THEN location WHEN industry <> 'all' THEN industry ELSE 'all' END AS filter_value FROM {_ask}")(
    lambda f: asked(f).select("c_custkey", *[c.alias(n) for c, n in zip(slice_of({d: F.col(d) for d in ("region", "location", "industry")}), ("filter_axis", "filter_value"))]))
query("IN4_compound_key", f"SELECT c_custkey, concat_ws('|', 'industry=' || industry, 'location=' || location, CASE WHEN region NOT IN ('', 'All') THEN 'region=' || region END) AS slice_key FROM {_ask}")(
    lambda f: asked(f).select("c_custkey", compound_key({d: F.col(d) for d in ("region", "location", "industry")}).alias("slice_key")))
query("IN5_latest_per_question", "SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY 1, 2")(lambda f: ins.latest_per(f.raw("conversations"), ["conv_id", "role"], "text", "turn"))
query("IN6_children", "SELECT a.conv_id, a.turn, a.turn - 1 AS parent_turn, a.role, p.role AS parent_role, length(p.text) AS parent_length FROM conversations a JOIN conversations p ON a.conv_id = p.conv_id AND p.turn = a.turn - 1")(
    lambda f: ins.children(f.raw("conversations").withColumn("parent_turn", F.when(F.col("turn") > 0, F.col("turn") - 1)), ["conv_id"], "turn", "parent_turn", ["role", "text"]).select(
        "conv_id", "turn", "parent_turn", "role", "parent_role", F.length("parent_text").cast("bigint").alias("parent_length")))
_IN1 = INSIGHTS.replace("WHEN v = p THEN 'flat' END, CASE", "WHEN v = p THEN 'flat' END AS trend_direction, CASE").replace("WHEN v = p THEN 'amber' END FROM", "WHEN v = p THEN 'amber' END AS status_color FROM")
query("GD14_insight_table", f"SELECT persona, slot_type, slot_id, headline, value, comparison, trend_direction, status_color, CAST(NULL AS VARCHAR) AS narrative, {ASOF} AS refreshed_on, {back(1)} AS fiscal_period_anchor, 'firmwide' AS filter_axis, 'all' AS filter_value FROM ({_IN1})")(
    lambda f: ins.insight_table(f).select("persona", "slot_type", "slot_id", "headline", "value", "comparison", "trend_direction", "status_color", "narrative",
                                          F.col("last_refreshed").cast("date").alias("refreshed_on"), "fiscal_period_anchor", "filter_axis", "filter_value"))
query("KP42_version", f"SELECT {ASOF} AS version FROM ({_IN1}) LIMIT 1")(
    lambda f: ins.version(ins.insight_table(f)).select(F.col("version").cast("date").alias("version")))
