"""Dataset domain (R5) and domain template candidates.

Both run over the whole catalog: the keyword and template tables are small
fixed tables (broadcast), joined to the column table on ``dataset_id``;
best matches are picked with windows partitioned by dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import semantics as S

# ---------------------------------------------------------------------------
# Domain keywords (primary, secondary) in declaration order;
# ties between domains go to the earlier one.
# ---------------------------------------------------------------------------
DOMAIN_KEYWORDS = [
    ("sales", "Sales",
     ["salesperson", "sales_rep", "rep_name", "quota", "pipeline", "closed_won", "closed_lost", "deal_stage",
      "territory", "commission", "target", "forecast", "win_rate", "conversion"],
     ["revenue", "amount", "deal", "client", "prospect", "lead"]),
    ("marketing", "Marketing",
     ["campaign", "impression", "click", "ctr", "cpc", "cpm", "roas", "conversion_rate", "ad_spend", "engagement",
      "reach", "bounce_rate", "session", "utm", "channel", "attribution"],
     ["revenue", "cost", "traffic", "audience", "funnel", "lead"]),
    ("finance", "Finance & Accounting",
     ["balance", "debit", "credit", "ledger", "journal", "account_number", "invoice", "tax", "vat", "gst",
      "payable", "receivable", "reconciliation", "budget", "forecast_amount", "fiscal"],
     ["expense", "profit", "income", "cost", "revenue", "payment"]),
    ("hr", "Human Resources",
     ["employee", "emp_id", "staff", "headcount", "department", "designation", "hire_date", "termination",
      "attrition", "payroll", "salary", "bonus", "leave", "attendance", "performance_rating", "appraisal"],
     ["name", "email", "manager", "team", "location", "age"]),
    ("crm", "CRM / Customer Management",
     ["lead", "contact", "opportunity", "account", "pipeline_stage", "deal_value", "follow_up", "support_ticket",
      "nps", "churn", "retention", "lifetime_value", "clv", "ltv", "renewal"],
     ["customer", "client", "email", "phone", "company", "status"]),
    ("inventory", "Inventory & Stock",
     ["sku", "stock", "warehouse", "reorder_point", "on_hand", "backorder", "lot_number", "expiry", "bin", "shelf",
      "shrinkage", "turnover", "days_on_hand", "po_number", "supplier"],
     ["quantity", "product", "item", "unit", "cost", "location"]),
    ("ecommerce", "E-Commerce",
     ["order_id", "cart", "checkout", "sku", "product_id", "category", "shipping", "return_rate", "refund", "gmv",
      "aov", "basket_size", "discount", "coupon", "fulfillment"],
     ["revenue", "quantity", "customer", "price", "transaction", "amount"]),
    ("customer_support", "Customer Support",
     ["ticket", "case_id", "priority", "escalation", "resolution_time", "first_response", "csat", "sla", "agent",
      "queue", "open_tickets", "closed_tickets", "sentiment", "feedback", "complaint"],
     ["customer", "status", "date", "channel", "category", "time"]),
    ("healthcare", "Healthcare",
     ["patient", "diagnosis", "icd", "procedure", "physician", "hospital", "admission", "discharge", "claim",
      "insurance", "dosage", "medication", "lab_result", "vitals", "appointment"],
     ["date", "age", "gender", "status", "cost", "id"]),
    ("education", "Education",
     ["student", "enrollment", "grade", "score", "course", "curriculum", "attendance", "graduation", "tuition",
      "instructor", "class_size", "gpa", "exam", "assignment", "subject"],
     ["name", "date", "id", "status", "level", "year"]),
    ("manufacturing", "Manufacturing",
     ["production", "batch", "machine", "shift", "oee", "defect", "yield", "scrap", "downtime", "cycle_time",
      "throughput", "wip", "bom", "plant", "line", "operator"],
     ["quantity", "date", "cost", "unit", "time", "status"]),
    ("logistics", "Logistics & Supply Chain",
     ["shipment", "tracking", "carrier", "freight", "delivery", "eta", "pod", "route", "driver", "fleet", "load",
      "container", "weight", "customs", "transit_time", "origin", "destination"],
     ["date", "status", "cost", "quantity", "id", "address"]),
    ("banking", "Banking & Financial Services",
     ["account_type", "transaction_type", "branch", "swift", "iban", "loan", "interest_rate", "emi", "collateral",
      "credit_score", "npa", "deposit", "withdrawal", "wire_transfer", "kyc"],
     ["balance", "amount", "date", "customer", "status", "id"]),
    ("project_management", "Project Management",
     ["task", "milestone", "sprint", "backlog", "story_point", "velocity", "epic", "assignee", "due_date",
      "completion_rate", "blocker", "burndown", "resource", "timeline", "deliverable"],
     ["status", "priority", "date", "team", "project", "id"]),
    ("general", "General / Analytics",
     ["value", "metric", "count", "total", "average", "sum", "percentage", "ratio", "index"],
     ["date", "name", "id", "category", "type", "status"]),
]

# ---------------------------------------------------------------------------
# Domain templates.  KPI: (id, title, role OR-groups, column
# patterns, aggregation, format, priority, relevance).  Chart: (id, title,
# type, x roles, x patterns, y roles or "count", y patterns, aggregation,
# priority).  Domains without a profile use the general one.
# ---------------------------------------------------------------------------
I, ST, MO, OR, PC, TE, CA, GE, AD, DE = (S.IDENTIFIER, S.STATUS, S.MONETARY, S.ORDINAL, S.PERCENTAGE, S.TEMPORAL,
                                         S.CATEGORICAL, S.GEOGRAPHIC, S.ADDITIVE, S.DEMOGRAPHIC)
KPI_TEMPLATES = {
    "hr": [
        ("total_employees", "Total Employees", [[I]], [r"employee_?id", r"emp_?id", r"staff_?id"],
         "count_distinct", "number", "primary", 100),
        ("active_employees", "Active Employees", [[ST]], [r"status", r"employment_?status", r"job_?status"],
         "count", "number", "primary", 95),
        ("avg_salary", "Average Monthly Salary", [[MO]],
         [r"salary", r"wage", r"pay", r"compensation", r"ctc", r"remuneration"], "avg", "currency", "primary", 94),
        ("avg_performance", "Average Performance Rating", [[OR]],
         [r"performance", r"rating", r"appraisal", r"score"], "avg", "number", "secondary", 88),
        ("avg_attendance", "Average Attendance", [[PC]], [r"attendance", r"presence", r"working_days"],
         "avg", "percent", "secondary", 85),
        ("attrition_rate", "Attrition Rate", [[ST], [TE]],
         [r"exit_?date", r"termination", r"resignation", r"status"], "count", "percent", "primary", 90),
    ],
    "sales": [
        ("total_revenue", "Total Revenue", [[MO]],
         [r"revenue", r"sales_?amount", r"total_?sales", r"amount"], "sum", "currency", "primary", 100),
        ("total_orders", "Total Orders", [[I], [AD]],
         [r"order_?id", r"transaction_?id", r"order_?count"], "count", "number", "primary", 95),
        ("avg_order_value", "Average Order Value", [[MO]],
         [r"amount", r"revenue", r"order_?value", r"sale_?value"], "avg", "currency", "primary", 88),
        ("total_customers", "Unique Customers", [[I]],
         [r"customer_?id", r"client_?id", r"cust_?id"], "count_distinct", "number", "secondary", 85),
    ],
    "ecommerce": [
        ("total_gmv", "Gross Merchandise Value", [[MO]], [r"gmv", r"revenue", r"sale_?price", r"amount"],
         "sum", "currency", "primary", 100),
        ("total_orders", "Total Orders", [[I]], [r"order_?id", r"transaction_?id"], "count", "number", "primary", 95),
        ("avg_order_value", "Average Order Value", [[MO]], [r"amount", r"revenue", r"price", r"value"],
         "avg", "currency", "primary", 90),
        ("return_rate", "Return Rate", [[PC]], [r"return_?rate", r"refund_?rate"], "avg", "percent", "secondary", 80),
    ],
    "finance": [
        ("total_revenue", "Total Revenue", [[MO]], [r"revenue", r"income", r"sales", r"inflow"],
         "sum", "currency", "primary", 100),
        ("total_expenses", "Total Expenses", [[MO]], [r"expense", r"cost", r"spend", r"outflow"],
         "sum", "currency", "primary", 95),
        ("net_profit", "Net Profit", [[MO]], [r"profit", r"net_?income", r"earnings", r"margin"],
         "sum", "currency", "primary", 98),
        ("avg_transaction", "Average Transaction Value", [[MO]], [r"amount", r"transaction", r"value"],
         "avg", "currency", "secondary", 80),
    ],
    "marketing": [
        ("total_spend", "Total Ad Spend", [[MO]], [r"spend", r"budget", r"cost", r"ad_?spend"],
         "sum", "currency", "primary", 95),
        ("avg_ctr", "Average Click-Through Rate", [[PC]], [r"ctr", r"click_?through", r"click_?rate"],
         "avg", "percent", "primary", 90),
        ("avg_conversion_rate", "Conversion Rate", [[PC]], [r"conversion_?rate", r"cvr"], "avg", "percent",
         "primary", 92),
        ("total_impressions", "Total Impressions", [[AD]], [r"impressions?", r"reach", r"views?"],
         "sum", "number", "secondary", 80),
    ],
    "inventory": [
        ("total_sku", "Total SKUs", [[I]], [r"sku", r"product_?id", r"item_?id"], "count_distinct", "number",
         "primary", 95),
        ("total_stock_value", "Total Stock Value", [[MO]], [r"value", r"cost", r"price", r"amount"],
         "sum", "currency", "primary", 92),
        ("total_units", "Total Units On Hand", [[AD]], [r"quantity", r"qty", r"units?", r"stock", r"on_?hand"],
         "sum", "number", "primary", 90),
    ],
    "crm": [
        ("total_contacts", "Total Contacts", [[I]], [r"contact_?id", r"customer_?id", r"lead_?id"],
         "count_distinct", "number", "primary", 95),
        ("total_pipeline_value", "Total Pipeline Value", [[MO]],
         [r"deal_?value", r"pipeline", r"opportunity_?value", r"amount"], "sum", "currency", "primary", 92),
        ("avg_nps", "Average NPS Score", [[OR]], [r"nps", r"satisfaction", r"score"], "avg", "number",
         "secondary", 80),
    ],
    "customer_support": [
        ("total_tickets", "Total Support Tickets", [[I]], [r"ticket_?id", r"case_?id", r"issue_?id"],
         "count", "number", "primary", 95),
        ("avg_csat", "Average CSAT Score", [[OR]], [r"csat", r"satisfaction", r"rating", r"score"],
         "avg", "number", "primary", 90),
        ("avg_resolution_time", "Average Resolution Time", [[AD, DE]],
         [r"resolution_?time", r"time_?to_?resolve", r"handling_?time"], "avg", "number", "secondary", 85),
    ],
    "healthcare": [
        ("total_patients", "Total Patients", [[I]], [r"patient_?id", r"patient_?no", r"case_?id"],
         "count_distinct", "number", "primary", 95),
        ("avg_length_of_stay", "Average Length of Stay", [[AD, DE]],
         [r"length_?of_?stay", r"los", r"days?", r"duration"], "avg", "number", "secondary", 85),
        ("total_claim_value", "Total Claim Value", [[MO]], [r"claim", r"amount", r"cost", r"charge"],
         "sum", "currency", "primary", 88),
    ],
    "education": [
        ("total_students", "Total Students", [[I]], [r"student_?id", r"enroll_?id"], "count_distinct", "number",
         "primary", 95),
        ("avg_score", "Average Score", [[OR]], [r"score", r"grade", r"marks?", r"gpa", r"percentage"],
         "avg", "number", "primary", 90),
        ("avg_attendance", "Average Attendance", [[PC]], [r"attendance", r"presence"], "avg", "percent",
         "secondary", 82),
    ],
    "manufacturing": [
        ("total_production", "Total Units Produced", [[AD]],
         [r"production", r"units?_?produced", r"output", r"manufactured"], "sum", "number", "primary", 95),
        ("defect_rate", "Defect Rate", [[PC]], [r"defect_?rate", r"rejection_?rate", r"scrap_?rate"],
         "avg", "percent", "primary", 90),
        ("avg_oee", "Average OEE", [[PC]], [r"oee", r"efficiency", r"utilization"], "avg", "percent",
         "secondary", 85),
    ],
    "logistics": [
        ("total_shipments", "Total Shipments", [[I]], [r"shipment_?id", r"tracking", r"order_?id"],
         "count", "number", "primary", 95),
        ("avg_delivery_time", "Average Delivery Time", [[AD]],
         [r"delivery_?time", r"transit_?time", r"lead_?time", r"days?_?to_?deliver"], "avg", "number",
         "primary", 90),
        ("on_time_delivery_rate", "On-Time Delivery Rate", [[PC]], [r"on_?time", r"otd", r"delivery_?rate"],
         "avg", "percent", "primary", 88),
    ],
    "general": [
        ("total_records", "Total Records", [[I, CA, MO]], [r".*"], "count", "number", "primary", 70),
        ("primary_metric", "Primary Metric Total", [[MO, AD]],
         [r"value", r"amount", r"total", r"metric"], "sum", "number", "primary", 65),
    ],
}
# The template that counts only rows with certain values.
TEMPLATE_VALUES = {"active_employees": ["Active", "active", "ACTIVE", "Current", "current", "Employed"]}
# Templates that are a share of all rows.  The rate of those who have left counts
# rows with a date of exit; with a status column alone, those whose status is
# none of the active ones.
SHARE_TEMPLATES = {"attrition_rate": TEMPLATE_VALUES["active_employees"]}
CHART_TEMPLATES = {
    "hr": [
        ("employees_by_department", "Employee Count by Department", "bar", [CA],
         [r"department", r"dept", r"division", r"team"], "count", [], "count", "primary"),
        ("avg_salary_by_department", "Average Salary by Department", "bar", [CA], [r"department", r"dept"],
         [MO], [r"salary", r"wage", r"pay"], "avg", "primary"),
        ("status_distribution", "Employee Status Distribution", "pie", [ST], [r"status", r"employment_?status"],
         "count", [], "count", "primary"),
        ("hiring_trend", "Hiring Trend Over Time", "line", [TE],
         [r"join(?:ing)?_?date", r"hire_?date", r"start_?date"], "count", [], "count", "primary"),
        ("performance_distribution", "Performance Rating Distribution", "bar", [OR], [r"performance", r"rating"],
         "count", [], "count", "secondary"),
        ("attendance_by_department", "Average Attendance by Department", "bar", [CA], [r"department"],
         [PC], [r"attendance"], "avg", "secondary"),
        ("avg_salary_by_role", "Average Salary by Role", "bar", [CA],
         [r"role", r"designation", r"job_?title", r"position"], [MO], [r"salary", r"wage"], "avg", "secondary"),
        ("employees_by_location", "Employee Count by Location", "bar", [GE],
         [r"location", r"city", r"branch", r"office"], "count", [], "count", "secondary"),
    ],
    "sales": [
        ("revenue_over_time", "Revenue Trend Over Time", "line", [TE], [r"date", r"time", r"period"],
         [MO], [r"revenue", r"amount", r"sales"], "sum", "primary"),
        ("revenue_by_category", "Revenue by Category", "bar", [CA],
         [r"category", r"product", r"type", r"segment"], [MO], [r"revenue", r"amount", r"sales"],
         "sum", "primary"),
        ("revenue_by_region", "Revenue by Region", "bar", [GE],
         [r"region", r"territory", r"country", r"state"], [MO], [r"revenue", r"amount"], "sum", "primary"),
        ("orders_by_status", "Order Status Distribution", "pie", [ST],
         [r"status", r"order_?status", r"fulfillment"], "count", [], "count", "secondary"),
    ],
    "ecommerce": [
        ("orders_over_time", "Orders Over Time", "line", [TE], [r"date", r"time", r"order_?date"], "count", [],
         "count", "primary"),
        ("revenue_by_category", "Revenue by Product Category", "bar", [CA],
         [r"category", r"product_?type", r"department"], [MO], [r"revenue", r"amount", r"price"], "sum", "primary"),
    ],
    "finance": [
        ("revenue_vs_expense", "Revenue vs Expenses Over Time", "line", [TE],
         [r"date", r"period", r"month", r"quarter"], [MO], [r"revenue", r"expense", r"income"], "sum", "primary"),
        ("expense_by_category", "Expenses by Category", "bar", [CA], [r"category", r"type", r"account_?type"],
         [MO], [r"expense", r"cost", r"amount"], "sum", "primary"),
    ],
    "marketing": [
        ("spend_by_channel", "Ad Spend by Channel", "bar", [CA], [r"channel", r"medium", r"platform", r"source"],
         [MO], [r"spend", r"cost", r"budget"], "sum", "primary"),
        ("performance_over_time", "Campaign Performance Over Time", "line", [TE],
         [r"date", r"time", r"period", r"week", r"month"], [PC, AD],
         [r"ctr", r"conversion", r"impressions", r"clicks"], "avg", "primary"),
    ],
    "inventory": [
        ("stock_by_category", "Stock Levels by Category", "bar", [CA], [r"category", r"type", r"department"],
         [AD], [r"quantity", r"qty", r"stock", r"units"], "sum", "primary"),
        ("inventory_value_by_location", "Inventory Value by Location", "bar", [GE],
         [r"location", r"warehouse", r"region"], [MO], [r"value", r"cost", r"amount"], "sum", "secondary"),
    ],
    "crm": [
        ("pipeline_by_stage", "Pipeline by Stage", "bar", [ST, CA], [r"stage", r"status", r"pipeline_?stage"],
         "count", [], "count", "primary"),
        ("leads_over_time", "New Leads Over Time", "line", [TE], [r"date", r"created_?at", r"signup_?date"],
         "count", [], "count", "primary"),
    ],
    "customer_support": [
        ("tickets_by_status", "Tickets by Status", "pie", [ST], [r"status", r"ticket_?status"], "count", [],
         "count", "primary"),
        ("tickets_by_category", "Tickets by Category", "bar", [CA], [r"category", r"type", r"issue_?type"],
         "count", [], "count", "primary"),
    ],
    "healthcare": [
        ("admissions_over_time", "Admissions Over Time", "line", [TE], [r"admission_?date", r"date", r"time"],
         "count", [], "count", "primary"),
        ("patients_by_diagnosis", "Patients by Diagnosis", "bar", [CA], [r"diagnosis", r"condition", r"icd"],
         "count", [], "count", "primary"),
    ],
    "education": [
        ("scores_by_course", "Average Score by Course", "bar", [CA], [r"course", r"subject", r"class", r"module"],
         [OR], [r"score", r"grade", r"marks"], "avg", "primary"),
    ],
    "manufacturing": [
        ("production_over_time", "Production Volume Over Time", "line", [TE],
         [r"date", r"time", r"shift_?date", r"batch_?date"], [AD], [r"production", r"output", r"units", r"quantity"],
         "sum", "primary"),
        ("defects_by_line", "Defects by Production Line", "bar", [CA], [r"line", r"machine", r"plant", r"shift"],
         [AD], [r"defect", r"reject", r"scrap", r"error"], "sum", "secondary"),
    ],
    "logistics": [
        ("shipments_by_carrier", "Shipments by Carrier", "bar", [CA], [r"carrier", r"courier", r"shipper", r"mode"],
         "count", [], "count", "primary"),
        ("shipments_over_time", "Shipments Over Time", "line", [TE], [r"date", r"ship_?date", r"delivery_?date"],
         "count", [], "count", "primary"),
    ],
    "general": [
        ("count_by_category", "Count by Category", "bar", [CA, ST], [], "count", [], "count", "primary"),
        ("metric_over_time", "Metric Over Time", "line", [TE], [], [MO, AD], [], "sum", "primary"),
    ],
}
EXCLUDED_FROM_ANALYTICS = [S.CONTACT, S.SENSITIVE]


def _norm_kw(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-z0-9_]", "_")


def _keyword_rows(file_name: bool = False) -> list[tuple]:
    rows = []
    for d_ord, (dom, label, prim, sec) in enumerate(DOMAIN_KEYWORDS):
        for kind, words in (("primary", prim), ("secondary", sec)):
            if file_name and kind != "primary":
                continue
            for k_ord, kw in enumerate(words):
                pts = 2 if file_name else (3 if kind == "primary" else 1)
                rows.append((d_ord, dom, label, kind, k_ord, kw, pts))
    return rows


_KW_SCHEMA = ("domain_order int, domain string, domain_label string, kind string, kw_order int, kw string, "
              "pts int")


def _substrings(name: Column) -> Column:
    """All substrings of a (short) name."""
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.transform(F.sequence(i, F.length(name)), lambda j: F.substring(name, i, j - i + 1))))


def _keyword_hits(df: DataFrame, name: Column, file_name: bool = False) -> DataFrame:
    """(dataset_id, keyword fields) for every keyword a name hits, as two
    equi-joins against fixed keyword tables (broadcast): 'name contains
    keyword' joins the name's substrings to the keywords; 'keyword contains
    name' (primary keywords) joins the name to the keywords' substrings."""
    spark = df.sparkSession
    kws = spark.createDataFrame(_keyword_rows(file_name), _KW_SCHEMA)
    named = df.select("dataset_id", name.alias("n")).filter(F.length("n") > 0)
    subs = named.select("dataset_id", F.explode(F.array_distinct(_substrings(F.col("n")))).alias("s"))
    contains = subs.join(F.broadcast(kws), F.col("s") == F.col("kw")).drop("s")
    if file_name:
        return contains.drop("kw")
    kw_subs = spark.createDataFrame(
        [r + (sub,) for r in _keyword_rows() if r[3] == "primary"
         for sub in {r[5][i:j] for i in range(len(r[5])) for j in range(i + 1, len(r[5]) + 1)}],
        _KW_SCHEMA + ", sub string")
    inside = named.join(F.broadcast(kw_subs), F.col("n") == F.col("sub")).drop("sub", "n")
    return contains.unionByName(inside).drop("kw")


def classify_domains(columns: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset_id, domain, domain_label, confidence, score).

    ``columns`` has (dataset_id, column); ``datasets`` has (dataset_id,
    file_name).  Each keyword counts once per dataset: +3 primary (column
    equals, contains or is contained in it), +2 if the file name contains a
    primary keyword, +1 secondary (equals or contains)."""
    col = _norm_kw(F.lower(F.col("column")))
    col_hits = _keyword_hits(columns, col).dropDuplicates(["dataset_id", "domain_order", "kind", "kw_order"])
    fn = F.regexp_replace(F.lower(F.col("file_name")), r"[^a-z0-9]", "_")
    f_hits = _keyword_hits(datasets, fn, file_name=True)
    scores = col_hits.unionByName(f_hits).groupBy("dataset_id", "domain_order", "domain", "domain_label") \
        .agg(F.sum("pts").alias("score"))
    w = Window.partitionBy("dataset_id").orderBy(F.desc("score"), "domain_order")
    ranked = scores.withColumn("rk", F.row_number().over(w))
    tot = scores.groupBy("dataset_id").agg(F.sum("score").alias("total"))
    top = ranked.filter(F.col("rk") == 1).join(
        ranked.filter(F.col("rk") == 2).select("dataset_id", F.col("score").alias("second")), "dataset_id", "left") \
        .join(tot, "dataset_id")
    dom = F.col("score") / (F.coalesce(F.col("second"), F.lit(0)) + 1)
    conf = F.least(F.lit(0.97), F.greatest(F.lit(0.45), F.lit(0.5) + F.col("score") / F.col("total") * 0.4
                                           + F.least(dom / 10, F.lit(0.07))))
    found = top.select("dataset_id", "domain", "domain_label",
                       (F.floor(conf * 100 + 0.5) / 100).alias("confidence"), "score")
    all_ds = datasets.select("dataset_id").distinct()
    return all_ds.join(found, "dataset_id", "left").select(
        "dataset_id", F.coalesce("domain", F.lit("general")).alias("domain"),
        F.coalesce("domain_label", F.lit("General / Analytics")).alias("domain_label"),
        F.coalesce("confidence", F.lit(0.4)).alias("confidence"), F.coalesce("score", F.lit(0)).alias("score"))


def _profile_key(domain: Column) -> Column:
    return F.when(domain.isin(list(KPI_TEMPLATES)), domain).otherwise(F.lit("general"))


def _template_tables(spark: SparkSession):
    k_rows, c_rows = [], []
    for dom, tpls in KPI_TEMPLATES.items():
        for t_ord, (tid, title, groups, pats, agg, fmt, prio, rel) in enumerate(tpls):
            test = "in" if tid in TEMPLATE_VALUES else "share" if tid in SHARE_TEMPLATES else None
            k_rows.append((dom, t_ord, tid, title, groups, [f"(?i){p}" for p in pats], agg, fmt, prio, rel, test,
                           TEMPLATE_VALUES.get(tid) or SHARE_TEMPLATES.get(tid)))
    for dom, tpls in CHART_TEMPLATES.items():
        for t_ord, (tid, title, ctype, xr, xp, yr, yp, agg, prio) in enumerate(tpls):
            c_rows.append((dom, t_ord, tid, title, ctype, xr, [f"(?i){p}" for p in xp],
                           None if yr == "count" else yr, [f"(?i){p}" for p in yp], agg, prio))
    k = spark.createDataFrame(k_rows, "profile string, t_order int, template_id string, title string, "
                                      "role_groups array<array<string>>, patterns array<string>, aggregation string, "
                                      "format string, priority string, relevance int, test string, test_values array<string>")
    c = spark.createDataFrame(c_rows, "profile string, t_order int, template_id string, title string, "
                                      "chart_type string, x_roles array<string>, x_patterns array<string>, "
                                      "y_roles array<string>, y_patterns array<string>, aggregation string, "
                                      "priority string")
    return k, c


def _best_column(cands: DataFrame, roles: Column, patterns: Column, any_role_ok: Column,
                 keys: list[str], role_groups: Column | None = None) -> DataFrame:
    """Three-pass best column: (1) pattern match with a wanted role, in
    pattern order then column order; (2) pattern match with an acceptable
    role; (3) first column with a wanted role (role order within OR-groups).
    ``cands`` holds one row per (template, column)."""
    pe = F.arrays_zip(F.sequence(F.lit(0), F.greatest(F.size(patterns) - 1, F.lit(0))).alias("i"),
                      patterns.alias("p"))
    x = cands.withColumn("_pp", F.explode_outer(F.when(F.size(patterns) > 0, pe)))
    matches = F.expr("`column` RLIKE _pp.p")
    in_roles = F.array_contains(roles, F.col("semantic_role"))
    r1 = F.when(F.col("_pp").isNotNull() & matches & in_roles,
                F.struct(F.lit(1).alias("pass"), F.col("_pp.i").alias("k"), F.col("ordinal").alias("o")))
    r2 = F.when(F.col("_pp").isNotNull() & matches & any_role_ok,
                F.struct(F.lit(2).alias("pass"), F.col("_pp.i").alias("k"), F.col("ordinal").alias("o")))
    if role_groups is not None:
        flat = F.flatten(role_groups)
        pos = F.array_position(flat, F.col("semantic_role"))
    else:
        pos = F.array_position(roles, F.col("semantic_role"))
    r3 = F.when(pos > 0, F.struct(F.lit(3).alias("pass"), pos.cast("int").alias("k"), F.col("ordinal").alias("o")))
    ranked = x.select(*keys, "column", "semantic_role", F.least(r1, r2, r3).alias("rk")).filter(F.col("rk").isNotNull())
    return ranked.groupBy(*keys).agg(F.min(F.struct("rk", "column", "semantic_role")).alias("b")) \
        .select(*keys, F.col("b.column").alias("column"), F.col("b.semantic_role").alias("semantic_role"))


def domain_kpi_candidates(sem: DataFrame, domains: DataFrame) -> DataFrame:
    """Domain template KPIs: best column per template, aggregation
    checked against the role, a non-count template never reuses a column
    taken by an earlier one.  A template with a condition on its column carries it
    (condition_test in / not in / present, condition_values); is_share: the KPI is
    the share of these rows in all rows."""
    spark = sem.sparkSession
    k_tpl, _ = _template_tables(spark)
    ds = domains.select("dataset_id", _profile_key(F.col("domain")).alias("profile"))
    tpl = ds.join(F.broadcast(k_tpl), "profile")
    cands = tpl.join(sem.select("dataset_id", "ordinal", "column", "semantic_role"), "dataset_id")
    roles = F.flatten(F.col("role_groups"))
    ok = ~F.col("semantic_role").isin(S.KPI_EXCLUDED_ROLES)
    keys = ["dataset_id", "t_order", "template_id", "title", "aggregation", "format", "priority", "relevance", "test", "test_values"]
    best = _best_column(cands, roles, F.col("patterns"), ok, keys, F.col("role_groups"))
    rules = S.aggregation_rules(spark)
    v = S.validate_aggregation(best, rules, "semantic_role", "aggregation").filter("valid")
    marks = ~F.col("aggregation").isin("count", "count_distinct")
    w = Window.partitionBy("dataset_id", "column").orderBy("t_order").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_used", F.coalesce(F.max(marks.cast("int")).over(w), F.lit(0)) > 0)
    v = v.filter(~(F.col("_used") & (F.col("aggregation") != "count")))
    share, dated = F.coalesce(F.col("test") == "share", F.lit(False)), F.col("semantic_role") == S.TEMPORAL
    test = F.when(share, F.when(dated, F.lit("present")).otherwise(F.lit("not in"))).otherwise(F.col("test"))
    return v.select("dataset_id", F.col("template_id").alias("kpi"), "column", "aggregation", "title", "format",
                    "semantic_role", "priority", "relevance", (F.col("t_order") + 500_000).alias("seq"),
                    F.lit("domain_profile").alias("source"), test.alias("condition_test"),
                    F.when(test.isin("in", "not in"), F.col("test_values")).alias("condition_values"), share.alias("is_share"))


def domain_chart_candidates(sem: DataFrame, domains: DataFrame) -> DataFrame:
    """Domain template charts (x then y column by the same three-pass
    rule; y aggregation checked; contact/sensitive axes skipped)."""
    spark = sem.sparkSession
    _, c_tpl = _template_tables(spark)
    ds = domains.select("dataset_id", _profile_key(F.col("domain")).alias("profile"))
    tpl = ds.join(F.broadcast(c_tpl), "profile")
    cols = sem.select("dataset_id", "ordinal", "column", "semantic_role")
    keys = ["dataset_id", "t_order", "template_id", "title", "chart_type", "aggregation", "priority", "y_roles",
            "y_patterns"]
    x = _best_column(tpl.join(cols, "dataset_id"), F.col("x_roles"), F.col("x_patterns"), F.lit(True), keys)
    x = x.withColumnRenamed("column", "x_field").withColumnRenamed("semantic_role", "x_role")
    has_y = F.col("y_roles").isNotNull()
    ykeys = keys + ["x_field", "x_role"]
    y = _best_column(x.filter(has_y).join(cols, "dataset_id"), F.col("y_roles"), F.col("y_patterns"), F.lit(True),
                     ykeys).withColumnRenamed("column", "y_field").withColumnRenamed("semantic_role", "y_role")
    counts = x.filter(~has_y).select(*ykeys, F.lit("_count").alias("y_field"), F.lit(None).cast("string").alias("y_role"))
    both = y.unionByName(counts)
    rules = S.aggregation_rules(spark)
    checked = S.validate_aggregation(both.filter(F.col("y_role").isNotNull()), rules, "y_role", "aggregation")
    checked = checked.withColumn("aggregation", F.when(F.col("valid"), F.col("aggregation"))
                                 .otherwise(F.coalesce(F.col("suggested"), S.preferred_aggregation(F.col("y_role")))))
    checked = S.validate_aggregation(checked.drop("valid", "reason", "suggested"), rules, "y_role", "aggregation") \
        .filter("valid").drop("valid", "reason", "suggested")
    out = checked.unionByName(both.filter(F.col("y_role").isNull()).withColumn("aggregation", F.lit("count")))
    out = out.filter(~F.col("x_role").isin(EXCLUDED_FROM_ANALYTICS) &
                     ~F.coalesce(F.col("y_role").isin(EXCLUDED_FROM_ANALYTICS), F.lit(False)))
    return out.select("dataset_id", "chart_type", "x_field", "y_field", "aggregation", "title", "x_role", "y_role",
                      F.col("template_id").alias("intent_type"), "priority", (F.col("t_order") + 500_000).alias("seq"),
                      F.lit("domain_profile").alias("source"))
