"""DuckDB SQL that computes the same results over the same test tables.

Ratios are rounded as decimals: DuckDB rounds a DOUBLE after scaling it in binary,
which moves ties such as 0.285, whereas Spark rounds its decimal text.
"""

from __future__ import annotations

PRODUCT = """
ev AS (
  SELECT c_custkey AS user_id,
         m.name AS event_type,
         TIMESTAMP '1995-01-01 09:30:00'
           + to_days(CAST(c_custkey % 2190 AS INTEGER)) + to_hours(m.hours) AS ts,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'tiktok'
                           WHEN 'FURNITURE' THEN 'google' ELSE 'meta' END AS channel
  FROM customer
  JOIN (VALUES ('install', 0, 1, TRUE), ('registration', 1, 14, FALSE), ('like', 2, 2, TRUE),
               ('match', 3, 4, TRUE), ('message_sent', 4, 16, TRUE), ('paywall_view', 5, 16, TRUE)
       ) AS m(name, hours, divisor, on_zero)
    ON (c_custkey % m.divisor = 0) = m.on_zero
)"""

PAYMENTS = """
pay AS (
  SELECT o_custkey AS user_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'purchase'
              WHEN o_orderpriority = '5-LOW' THEN 'upsell' ELSE 'rebill' END AS event,
         o_orderdate AS ts,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount
  FROM orders
)"""

ADS = """
line AS (
  SELECT l_partkey % 10 AS ad_id,
         (l_partkey % 10) * 6 // 10 AS campaign_id,
         CAST(l_shipdate AS DATE) AS day,
         (l_orderkey * 7 + l_linenumber * 131 + l_suppkey) % 1440 AS minute,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS price_cents,
         CAST(l_quantity AS BIGINT) AS quantity,
         l_suppkey, l_linenumber
  FROM lineitem
),
ad AS (
  SELECT CASE WHEN campaign_id < 2 THEN 'meta' WHEN campaign_id < 4 THEN 'tiktok'
              ELSE 'google' END AS source,
         campaign_id, ad_id AS adset_id, ad_id, day,
         CAST(((minute + 1) * (4000 + 500 * campaign_id) + price_cents % 4000)
              * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS spend,
         (minute + 1) * 1000 + quantity * 10 AS impressions,
         (minute + 1) * (20 + campaign_id) + l_suppkey % 10 AS clicks,
         (minute + 1) * 8 + l_linenumber % 4 AS installs,
         (minute + 1) * 6 + l_linenumber % 3 AS registrations,
         strftime(CAST(day AS TIMESTAMP) + to_minutes(minute), '%Y-%m-%d %H:%M:%S') AS loaded
  FROM line
)"""

#: Only the one form of a load time counts.
LOADED = """(CASE WHEN regexp_full_match(loaded, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')
  THEN TRY_CAST(loaded AS TIMESTAMP) END)"""

LAST_ADS = f"""
last_ad AS (
  SELECT *, {LOADED} AS snapshot_ts
  FROM ad
  QUALIFY ROW_NUMBER() OVER (
    PARTITION BY ad_id, day
    ORDER BY {LOADED} DESC NULLS LAST, spend DESC, impressions DESC,
             clicks DESC, installs DESC, registrations DESC,
             source, campaign_id, adset_id) = 1
)"""

MEASURES = ("spend", "impressions", "clicks", "installs", "registrations")
KINDS = ("purchase", "rebill", "upsell")

_per_kind_user = ",\n         ".join(
    f"COUNT(*) FILTER (WHERE event = '{k}') AS {k}_n,"
    f" SUM(CASE event WHEN '{k}' THEN amount ELSE 0 END) AS {k}_sum"
    for k in KINDS
)
_per_kind_channel = ",\n         ".join(
    f"COUNT(user_id) FILTER (WHERE {k}_n > 0) AS {k}_users,"
    f" SUM({k}_n) AS {k}_events, SUM({k}_sum) AS {k}_revenue"
    for k in KINDS
)

USERS = f"""
cohort AS (
  SELECT user_id, channel, MIN(ts) AS joined FROM ev
  WHERE event_type = 'registration' GROUP BY ALL
),
per_user AS (
  SELECT c.user_id, c.channel, c.joined,
         {_per_kind_user},
         SUM(COALESCE(amount, 0)) AS revenue
  FROM cohort c
  LEFT JOIN pay p
    ON p.user_id = c.user_id AND p.ts >= c.joined AND p.ts < c.joined + INTERVAL 6 MONTH
  GROUP BY c.user_id, c.channel, c.joined
)"""

_user_sums = f"""COUNT(user_id) AS registered,
         COUNT(user_id) FILTER (WHERE revenue > 0) AS payers,
         {_per_kind_channel},
         SUM(revenue) AS revenue"""

CHANNELS = f"""
per_channel AS (
  SELECT channel, {_user_sums}
  FROM per_user GROUP BY channel
)"""


def _with(*parts: str) -> str:
    return "WITH" + ",".join(parts) + "\n"


def _div(num: str, den: str, scale: int = 1) -> str:
    times = "" if scale == 1 else f" * {scale}.0"
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0){times})"


def _round(x: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def _ratio(num: str, den: str, digits: int, scale: int = 1) -> str:
    return _round(_div(num, den, scale), digits)


def _money(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND({x}, {digits}) AS DOUBLE)"


def _scaled_sum(measure: str) -> str:
    return f"CAST(SUM({measure}) AS DECIMAL(36,2)) * CAST(0.01 AS DECIMAL(2,2))"


_AVG_AMOUNT = _ratio("SUM(amount)", "COUNT(amount)", 2)
_MIN_MAX = f"{_money('MIN(amount)')} AS min_amount, {_money('MAX(amount)')} AS max_amount"

# Unrounded LTV parts over `per_channel`; B = purchase_users, R = registered.
_CR = _div("purchase_users", "registered")
_AOV = {k: _div(f"{k}_revenue", f"{k}_events") for k in KINDS}
_REBILLS = _div("rebill_events", "purchase_users")
_UPSELLS = _div("upsell_users", "purchase_users")
_PER_PAYER = f"({_AOV['purchase']} + {_AOV['rebill']} * {_REBILLS} + {_AOV['upsell']} * {_UPSELLS})"
_LTV = f"({_CR} * {_PER_PAYER})"
_SHARE = _ratio("revenue", "SUM(revenue) OVER ()", 4)

_MEASURE_SUMS = ", ".join(f"SUM({m}) AS {m}" for m in MEASURES)
SOURCES = f"""
per_source AS (SELECT source, {_MEASURE_SUMS} FROM last_ad GROUP BY source)"""

# Every stored measure is divided by 100; the factor cancels in all rates but is kept.
_RATES = {
    "cpm": _div("spend / 100", "impressions / 100", 1000),
    "ctr_pct": _div("clicks / 100", "impressions / 100", 100),
    "cr_click_install_pct": _div("installs / 100", "clicks / 100", 100),
    "cr_install_reg_pct": _div("registrations / 100", "installs / 100", 100),
    "cac": _div("spend / 100", "registrations / 100"),
}
_SPEND = _round("spend / 100", 2)
_RATE_COLUMNS = ", ".join(f"{_round(x, 2)} AS {name}" for name, x in _RATES.items())


def _nulls(columns: dict[str, str], label: str, relation: str) -> str:
    counts = ", ".join(
        f"{'CAST(NULL AS BIGINT)' if c is None else f'COUNT(*) FILTER (WHERE {c} IS NULL)'} AS {n}"
        for n, c in columns.items()
    )
    return f"SELECT '{label}' AS table_name, COUNT(*) AS rows_total, {counts} FROM {relation}"


def _duplicates(keys: str, label: str, relation: str) -> str:
    return f"""SELECT '{label}' AS table_name, COUNT(*) AS unique_keys,
       CAST(SUM(n) AS BIGINT) AS rows_total, COUNT(*) FILTER (WHERE n > 1) AS duplicated_keys,
       CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_rows
FROM (SELECT {keys}, COUNT(*) AS n FROM {relation} GROUP BY {keys})"""


def _span(label: str, relation: str) -> str:
    return f"""SELECT '{label}' AS table_name, MIN(ts) AS earliest_timestamp,
       MAX(ts) AS latest_timestamp,
       CAST(CAST(MAX(ts) AS DATE) - CAST(MIN(ts) AS DATE) + 1 AS BIGINT) AS days_covered
FROM {relation}"""


def _events_by(columns: str, entities: str = "unique_users") -> str:
    names = ", ".join(c.split(" AS ")[-1] for c in columns.split(", "))
    return (
        _with(PRODUCT)
        + f"SELECT {columns}, COUNT(*) AS events_count, COUNT(DISTINCT user_id) AS {entities}"
        + f" FROM ev GROUP BY {names}"
    )


def _column(table: str, relation: str, name: str, column: str, kind: str, nullable: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{name}' AS column_name,
       CASE ANY_VALUE(typeof({column})) WHEN '{kind}' THEN
         CASE '{kind}' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                       ELSE lower('{kind}') END END AS data_type,
       '{nullable}' AS is_nullable, COUNT(*) FILTER (WHERE {column} IS NULL) AS null_rows
FROM {relation}"""


def _funnel_rows(relation: str, steps: list, value: str, by: str = "", overall: bool = True) -> str:
    """One SELECT per step; a step is (name, count column, parent column or None)."""
    first = steps[0][1]
    selects = []
    for number, (name, column, parent) in enumerate(steps, start=1):
        rate = "CAST(NULL AS DOUBLE)" if parent is None else _ratio(column, parent, 4)
        total = f", {_ratio(column, first, 4)} AS overall_cr" if overall else ""
        selects.append(
            f"SELECT {by}CAST({number} AS BIGINT) AS step_no, '{name}' AS step,"
            f" {column} AS {value}, {rate} AS step_cr{total} FROM {relation}"
        )
    return "\nUNION ALL\n".join(selects)


def _chain(names: list[str]) -> list[tuple]:
    return list(zip(names, names, [None, *names[:-1]], strict=True))


def _reconciled(product: str, marketing: str) -> str:
    return f""",
users AS (
  SELECT channel, CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS n
  FROM {product} WHERE event_type = 'registration' GROUP BY channel
),
marketed AS (
  SELECT source, {_round("SUM(registrations) / 100", 0)} AS n FROM {marketing} GROUP BY source
)
SELECT COALESCE(users.channel, source) AS channel, marketed.n AS marketing_registrations,
       users.n AS product_registered_users, marketed.n - users.n AS difference
FROM users FULL JOIN marketed ON users.channel = source"""


def _zero_checks(subject: str, relation: str, conditions: dict[str, str]) -> str:
    """One row per condition with the number of rows that meet it."""
    lists = ", ".join(f"'{name}'" for name in conditions)
    counts = ", ".join(f"COUNT(*) FILTER (WHERE {c})" for c in conditions.values())
    return f"""SELECT '{subject}' AS subject, unnest([{lists}]) AS "check",
       unnest([{counts}]) AS observed FROM {relation}"""


_ADS_NAMES = {
    name: {"date": "day", "timestamp": "loaded"}.get(name, name)
    for name in ("source", "campaign_id", "adset_id", "ad_id", "date", *MEASURES, "timestamp")
}
_ROW_TEXT = """SELECT concat_ws('|', source, campaign_id, adset_id, ad_id, day, spend, impressions,
                 clicks, installs, registrations, loaded) AS row_text FROM ad"""
_USER_FLAGS = """SELECT user_id, bool_or(event_type = 'install') AS inst,
         bool_or(event_type = 'registration') AS reg,
         bool_or(event_type IN ('like', 'match', 'message_sent', 'paywall_view')) AS deep
  FROM ev GROUP BY user_id"""
_VERDICTS = "\nUNION ALL\n".join(
    [
        _zero_checks(
            "product_events",
            "ev",
            {
                "null_user_id": "user_id IS NULL",
                "null_event_type": "event_type IS NULL",
                "null_timestamp": "ts IS NULL",
                "null_channel": "channel IS NULL",
            },
        ),
        _zero_checks(
            "orders",
            "pay",
            {
                "null_user_id": "user_id IS NULL",
                "null_event": "event IS NULL",
                "null_timestamp": "ts IS NULL",
                "null_amount": "amount IS NULL",
                "zero_amount": "amount = 0",
                "negative_amount": "amount < 0",
                "very_high_amount": "amount > 999",
            },
        ),
        _zero_checks(
            "marketing_ads_raw",
            "ad",
            {
                **{f"null_{name}": f"{c} IS NULL" for name, c in _ADS_NAMES.items()},
                "invalid_timestamp_rows": f"{LOADED} IS NULL",
                **{f"negative_{m}": f"{m} < 0" for m in MEASURES},
                "clicks_gt_impressions": "clicks > impressions",
                "installs_gt_clicks": "installs > clicks",
                "registrations_gt_installs": "registrations > installs",
            },
        ),
        _zero_checks(
            "product_events",
            f"({_USER_FLAGS})",
            {
                "users_registration_without_install": "reg AND NOT inst",
                "users_deeper_events_without_registration": "deep AND NOT reg",
            },
        ),
        _zero_checks(
            "orders",
            "(SELECT DISTINCT user_id FROM pay) payer",
            {
                "paying_users_without_product_events": "user_id IS NULL OR NOT EXISTS"
                " (SELECT 1 FROM ev WHERE ev.user_id = payer.user_id)"
            },
        ),
        """SELECT 'product_events', 'duplicate_rows',
       COUNT(*) - COUNT(DISTINCT (user_id, event_type, ts, channel)) FROM ev""",
        """SELECT 'orders', 'duplicate_rows',
       COUNT(*) - COUNT(DISTINCT (user_id, event, ts, amount)) FROM pay""",
        f"""SELECT 'marketing_ads_raw', 'duplicate_rows',
       COUNT(*) - COUNT(DISTINCT ({', '.join(_ADS_NAMES.values())})) FROM ad""",
        *(
            f"SELECT '{table}', 'empty_table', CAST(COUNT(*) = 0 AS BIGINT) FROM {relation}"
            for table, relation in (("product_events", "ev"), ("orders", "pay"), ("marketing_ads_raw", "ad"))
        ),
    ]
)

_MILESTONES = ["install", "registration", "like", "match", "message_sent", "paywall_view"]
_ECONOMICS = f""",
economics AS (
  SELECT COALESCE(channel, source) AS channel, registered AS registered_users,
         {_money("c.revenue")} AS total_revenue_6m, share AS revenue_share, {_SPEND} AS total_spend,
         {_round(_RATES["cac"], 2)} AS cac, {_round("ltv", 2)} AS ltv_6m_per_registered_user,
         {_ratio("ltv", _RATES["cac"], 2)} AS ltv_cac
  FROM (SELECT *, {_SHARE} AS share, {_LTV} AS ltv FROM per_channel) c
  FULL JOIN per_source ON channel = source
)"""
_ALL = (PRODUCT, PAYMENTS, USERS, CHANNELS, ADS, LAST_ADS, SOURCES)

_FULL_MONTHS = " + ".join("CASE WHEN joined + INTERVAL {k} MONTH <= {until} THEN 1 ELSE 0 END".replace("{k}", str(k)) for k in range(1, 7))
_CENSORED = f""",
seen AS (SELECT *, {_FULL_MONTHS.replace("{until}", "(SELECT MAX(ts) FROM pay)")} AS observed FROM cohort),
kept AS (
  SELECT * FROM (
    SELECT s.user_id, channel, observed, event, amount, {_FULL_MONTHS.replace("{until}", "p.ts")} AS age
    FROM seen s JOIN pay p ON p.user_id = s.user_id AND p.ts >= joined AND p.ts < joined + INTERVAL 6 MONTH
  ) WHERE age < observed
),
firsts AS (
  SELECT s.user_id, s.channel, s.observed, MIN(age) FILTER (WHERE event = 'purchase') AS purchased,
         MIN(age) FILTER (WHERE event = 'upsell') AS upsold
  FROM seen s LEFT JOIN kept ON kept.user_id = s.user_id AND kept.channel = s.channel GROUP BY ALL
),
risk AS (
  SELECT channel, k, COUNT(*) FILTER (WHERE observed > k) AS r,
         {", ".join(f"COUNT(*) FILTER (WHERE observed > k AND COALESCE({c} >= k, TRUE)) AS r_{c}, COUNT(*) FILTER (WHERE observed > k AND {c} = k) AS d_{c}" for c in ("purchased", "upsold"))}
  FROM firsts, (SELECT unnest(range(6)) AS k) GROUP BY ALL
),
paid AS (
  SELECT channel, age AS k, SUM(amount) AS revenue, SUM(amount) FILTER (WHERE event = 'rebill') AS rebills FROM kept GROUP BY ALL
),
by_month AS (
  SELECT channel, k,
         {", ".join(f"CASE WHEN r > 0 AND r_{c} = 0 THEN 1.0 ELSE 1 - {_div(f'd_{c}', f'r_{c}')} END AS stay_{c}" for c in ("purchased", "upsold"))},
         {", ".join(f"{_div(f'COALESCE({c}, 0)', 'r')} AS {c}" for c in ("revenue", "rebills"))}
  FROM risk LEFT JOIN paid USING (channel, k)
),
estimates AS (
  SELECT channel, {", ".join(f"CASE WHEN COUNT(stay_{c}) = 6 THEN 1 - list_reduce(list(CAST(stay_{c} AS DOUBLE) ORDER BY k), lambda a, b: a * b) END AS {c}" for c in ("purchased", "upsold"))},
         {", ".join(f"CASE WHEN COUNT({c}) = 6 THEN list_reduce(list({c} ORDER BY k), lambda a, b: a + b) END AS {c}" for c in ("revenue", "rebills"))}
  FROM by_month GROUP BY channel
),
means AS (
  SELECT channel, {", ".join(f"{_div(f"SUM(amount) FILTER (WHERE event = '{k}')", f"COUNT(*) FILTER (WHERE event = '{k}')")} AS aov_{k}" for k in ("purchase", "upsell"))}
  FROM kept GROUP BY channel
)
SELECT channel, COUNT(*) AS registered_users, COUNT(*) FILTER (WHERE observed = 6) AS matured_users,
       CAST(SUM(observed) AS BIGINT) AS observed_months, {_round("ANY_VALUE(purchased_part)", 4)} AS conversion,
       {_round("ANY_VALUE(revenue)", 2)} AS revenue_per_user,
       {_round("ANY_VALUE(purchased_part * aov_purchase + rebills + upsold_part * aov_upsell)", 2)} AS ltv_6m_per_registered_user
FROM firsts
JOIN (SELECT channel, purchased AS purchased_part, upsold AS upsold_part, revenue, rebills FROM estimates) USING (channel)
LEFT JOIN means USING (channel) GROUP BY channel"""

_SHIFTED = {"lowest": -0.01, "exact": 0.0, "highest": 0.01}
_RANKED = "\nUNION ALL\n".join(
    f"SELECT event, channel, '{name}' AS quantile, COUNT(*) AS payments, "
    + ", ".join(
        _money(f"MAX(amount) FILTER (WHERE rn = GREATEST(1, CAST(CEIL(n * CAST({round(p + by, 6)} AS DOUBLE)) AS BIGINT)))") + f" AS {at}_amount"
        for at, by in _SHIFTED.items()
    )
    + ", TRUE AS within_bound FROM ranked GROUP BY event, channel"
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
)

ORACLE: dict[str, str] = {
    "schema_overview": _with(PRODUCT, PAYMENTS)
    + "\nUNION ALL\n".join(
        [
            _column("product_events", "ev", "user_id", "user_id", "BIGINT", "YES"),
            _column("product_events", "ev", "event_type", "event_type", "VARCHAR", "NO"),
            _column("product_events", "ev", "timestamp", "ts", "TIMESTAMP", "YES"),
            _column("product_events", "ev", "channel", "channel", "VARCHAR", "NO"),
            _column("orders", "pay", "user_id", "user_id", "BIGINT", "YES"),
            _column("orders", "pay", "event", "event", "VARCHAR", "NO"),
            _column("orders", "pay", "timestamp", "ts", "TIMESTAMP", "YES"),
            _column("orders", "pay", "amount", "amount", "DECIMAL(12,2)", "YES"),
        ]
    ),
    "preview_product_events": _with(PRODUCT)
    + 'SELECT user_id, event_type, ts AS "timestamp", channel FROM ev ORDER BY ALL LIMIT 10',
    "preview_orders": _with(PAYMENTS)
    + """SELECT user_id, event, ts AS "timestamp", CAST(amount AS DOUBLE) AS amount
FROM pay ORDER BY ALL LIMIT 10""",
    "table_volume": _with(PRODUCT, PAYMENTS)
    + """SELECT 'product_events' AS table_name, COUNT(*) AS rows_total,
       COUNT(DISTINCT user_id) AS unique_users FROM ev
UNION ALL SELECT 'orders', COUNT(*), COUNT(DISTINCT user_id) FROM pay""",
    "date_coverage": _with(PRODUCT, PAYMENTS)
    + _span("product_events", "ev")
    + "\nUNION ALL\n"
    + _span("orders", "pay"),
    "product_event_types": _events_by("event_type"),
    "revenue_event_types": _with(PAYMENTS)
    + f"""SELECT event, COUNT(*) AS events_count, COUNT(DISTINCT user_id) AS unique_users,
       {_money("SUM(amount)")} AS total_revenue, {_AVG_AMOUNT} AS avg_amount
FROM pay GROUP BY event""",
    "channel_overview": _events_by("channel"),
    "channel_event_breakdown": _events_by("channel, event_type"),
    "daily_activity": _events_by("CAST(ts AS DATE) AS event_date", "active_users"),
    "daily_revenue": _with(PAYMENTS)
    + f"""SELECT CAST(ts AS DATE) AS order_date, COUNT(*) AS revenue_events,
       COUNT(DISTINCT user_id) AS paying_users, {_money("SUM(amount)")} AS total_revenue,
       {_AVG_AMOUNT} AS avg_order_value
FROM pay GROUP BY 1""",
    "amount_distribution": _with(PAYMENTS)
    + f"""SELECT COUNT(*) AS rows_total, COUNT(amount) AS rows_with_amount, {_MIN_MAX},
       {_AVG_AMOUNT} AS avg_amount,
       {_money("quantile_disc(amount, 0.25)")} AS p25_amount,
       {_money("quantile_disc(amount, 0.5)")} AS median_amount,
       {_money("quantile_disc(amount, 0.75)")} AS p75_amount
FROM pay WHERE amount IS NOT NULL""",
    "aov_by_event": _with(PAYMENTS)
    + f"""SELECT event, COUNT(*) AS revenue_events, COUNT(DISTINCT user_id) AS paying_users,
       {_money("SUM(amount)")} AS total_revenue, {_AVG_AMOUNT} AS avg_order_value, {_MIN_MAX}
FROM pay WHERE amount IS NOT NULL GROUP BY event""",
    "ads_overview": _with(ADS)
    + f"""SELECT 'marketing_ads_raw' AS table_name, COUNT(*) AS rows_total,
       COUNT(DISTINCT source) AS unique_sources, COUNT(DISTINCT campaign_id) AS unique_campaigns,
       COUNT(DISTINCT adset_id) AS unique_adsets, COUNT(DISTINCT ad_id) AS unique_ads,
       MIN(day) AS earliest_date, MAX(day) AS latest_date,
       CAST(MAX(day) - MIN(day) + 1 AS BIGINT) AS days_covered,
       MIN({LOADED}) AS earliest_timestamp,
       MAX({LOADED}) AS latest_timestamp
FROM ad""",
    "dq_nulls": _with(PRODUCT, PAYMENTS)
    + _nulls(
        {
            "null_user_id": "user_id",
            "null_event_name": "event_type",
            "null_timestamp": "ts",
            "null_channel": "channel",
            "null_amount": None,
        },
        "product_events",
        "ev",
    )
    + "\nUNION ALL\n"
    + _nulls(
        {
            "null_user_id": "user_id",
            "null_event_name": "event",
            "null_timestamp": "ts",
            "null_channel": None,
            "null_amount": "amount",
        },
        "orders",
        "pay",
    ),
    "dq_duplicates": _with(PRODUCT, PAYMENTS)
    + _duplicates("user_id, event_type, ts, channel", "product_events", "ev")
    + "\nUNION ALL\n"
    + _duplicates("user_id, event, ts, amount", "orders", "pay"),
    "dq_amount_validity": _with(PAYMENTS)
    + f"""SELECT COUNT(*) AS rows_total,
       COUNT(*) FILTER (WHERE amount IS NULL) AS null_amount,
       COUNT(*) FILTER (WHERE amount = 0) AS zero_amount,
       COUNT(*) FILTER (WHERE amount < 0) AS negative_amount,
       COUNT(*) FILTER (WHERE amount > 999) AS very_high_amount,
       {_MIN_MAX}, {_AVG_AMOUNT} AS avg_amount
FROM pay""",
    "dq_amount_by_event": _with(PAYMENTS)
    + f"""SELECT event, COUNT(*) AS rows_total, COUNT(DISTINCT amount) AS distinct_amount_values,
       {_MIN_MAX}, {_AVG_AMOUNT} AS avg_amount
FROM pay GROUP BY event""",
    "dq_period_overhang": _with(PRODUCT, PAYMENTS)
    + f"""SELECT COUNT(*) AS orders_total,
       COUNT(*) FILTER (WHERE ts < (SELECT MIN(ts) FROM ev)) AS orders_before_product_period,
       COUNT(*) FILTER (WHERE ts > (SELECT MAX(ts) FROM ev)) AS orders_after_product_period,
       {_money("SUM(CASE WHEN ts > (SELECT MAX(ts) FROM ev) THEN amount ELSE 0 END)")}
         AS revenue_after_product_period
FROM pay""",
    "dq_funnel": _with(PRODUCT)
    + """SELECT COUNT(*) FILTER (WHERE reg) AS users_with_registration,
       COUNT(*) FILTER (WHERE reg AND NOT inst) AS users_registration_without_install,
       COUNT(*) FILTER (WHERE deep) AS users_with_deeper_events,
       COUNT(*) FILTER (WHERE deep AND NOT reg) AS users_deeper_events_without_registration
FROM ("""
    + _USER_FLAGS
    + ")",
    "dq_paying_users": _with(PRODUCT, PAYMENTS)
    + """SELECT COUNT(*) AS paying_users_total,
       COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = p.user_id))
         AS paying_users_without_product_events
FROM (SELECT DISTINCT user_id FROM pay) p""",
    "dq_ads_nulls": _with(ADS)
    + _nulls(
        {f"null_{name}": c for name, c in _ADS_NAMES.items()},
        "marketing_ads_raw",
        "ad",
    ),
    "dq_ads_duplicates_strict": _with(ADS)
    + f"""SELECT COUNT(*) AS rows_total, COUNT(DISTINCT ({', '.join(_ADS_NAMES.values())})) AS unique_raw_keys,
       COUNT(*) - COUNT(DISTINCT ({', '.join(_ADS_NAMES.values())})) AS duplicate_rows FROM ad""",
    "dq_multi_channel_users": _with(PRODUCT)
    + """SELECT COUNT(*) AS users_total, COUNT(*) FILTER (WHERE n > 1) AS users_with_several_channels
FROM (SELECT user_id, COUNT(DISTINCT channel) AS n FROM ev WHERE user_id IS NOT NULL GROUP BY user_id)""",
    "dq_ads_duplicates": _with(ADS)
    + """SELECT COUNT(*) AS rows_total, COUNT(DISTINCT row_text) AS unique_raw_keys,
       COUNT(*) - COUNT(DISTINCT row_text) AS duplicate_rows
FROM ("""
    + _ROW_TEXT
    + ")",
    "dq_ads_timestamp": _with(ADS)
    + f"""SELECT COUNT(*) AS rows_total, COUNT(*) FILTER (WHERE t IS NULL) AS invalid_timestamp_rows,
       MIN(t) AS earliest_timestamp, MAX(t) AS latest_timestamp
FROM (SELECT {LOADED} AS t FROM ad)""",
    "dq_ads_metric_validity": _with(ADS)
    + "SELECT COUNT(*) AS rows_total, "
    + ", ".join(f"COUNT(*) FILTER (WHERE {m} < 0) AS negative_{m}" for m in MEASURES)
    + f""", CAST(MIN(spend) AS DOUBLE) AS min_spend, CAST(MAX(spend) AS DOUBLE) AS max_spend,
       {_ratio("SUM(spend)", "COUNT(spend)", 2)} AS avg_spend
FROM ad""",
    "dq_ads_funnel": _with(ADS)
    + """SELECT COUNT(*) AS rows_total,
       COUNT(*) FILTER (WHERE clicks > impressions) AS clicks_gt_impressions,
       COUNT(*) FILTER (WHERE installs > clicks) AS installs_gt_clicks,
       COUNT(*) FILTER (WHERE registrations > installs) AS registrations_gt_installs
FROM ad""",
    "dq_snapshot_structure": _with(ADS)
    + """SELECT n AS snapshots_per_ad_day, COUNT(*) AS ad_day_groups
FROM (SELECT COUNT(*) AS n FROM ad GROUP BY ad_id, day) GROUP BY n""",
    "dq_verdicts": _with(PRODUCT, PAYMENTS, ADS)
    + 'SELECT subject, "check", observed, CAST(0 AS BIGINT) AS expected,'
    + f" observed = 0 AS passed FROM ({_VERDICTS})",
    "ltv_by_channel": _with(PRODUCT, PAYMENTS, USERS, CHANNELS)
    + f"""SELECT channel, registered AS registered_users, purchase_users AS buyers,
       {_money("revenue")} AS total_revenue_6m, {_SHARE} AS revenue_share,
       {_round(_CR, 4)} AS cr_registration_to_purchase,
       {_round(_AOV["purchase"], 2)} AS aov_first_purchase,
       {_round(_PER_PAYER, 2)} AS ltv_6m_per_payer,
       {_round(f"{_CR} * {_AOV['purchase']}", 2)} AS ltv_component_first_purchase,
       rebill_users, {_round(_REBILLS, 4)} AS freq_rebills_per_payer_6m,
       {_round(_AOV["rebill"], 2)} AS aov_rebill,
       {_round(f"{_CR} * {_AOV['rebill']} * {_REBILLS}", 2)} AS ltv_component_rebill,
       upsell_users, {_round(_UPSELLS, 4)} AS cr_sub_to_upsell,
       {_round(_AOV["upsell"], 2)} AS aov_upsell,
       {_round(f"{_CR} * {_AOV['upsell']} * {_UPSELLS}", 2)} AS ltv_component_upsell,
       {_round(_LTV, 2)} AS ltv_6m_per_registered_user
FROM per_channel""",
    "revenue_scale_by_channel": _with(PRODUCT, PAYMENTS, USERS, CHANNELS)
    + f"""SELECT channel, registered AS registered_users, payers AS paying_users,
       {_money("revenue")} AS total_revenue_6m,
       {", ".join(f"{_money(f'{k}_revenue')} AS {k}_revenue_6m" for k in KINDS)},
       {_ratio("revenue", "payers", 2)} AS arppu_6m_per_payer,
       {_ratio("revenue", "registered", 2)} AS arpu_6m_per_registered_user,
       {_SHARE} AS revenue_share
FROM per_channel""",
    "matured_cohort_ltv": _with(PRODUCT, PAYMENTS, USERS)
    + f""", per_channel AS (
  SELECT channel, joined + INTERVAL 6 MONTH <= (SELECT MAX(ts) FROM pay) AS matured,
         {_user_sums}
  FROM per_user GROUP BY ALL
)
SELECT channel, matured, registered AS registered_users, purchase_users AS buyers,
       {_money("revenue")} AS total_revenue_6m, {_round(_LTV, 2)} AS ltv_6m_per_registered_user
FROM per_channel""",
    "censored_cohort_ltv": _with(PRODUCT, PAYMENTS)
    + """, cohort AS (
  SELECT user_id, channel, MIN(ts) AS joined FROM ev WHERE event_type = 'registration' GROUP BY ALL
)"""
    + _CENSORED,
    "activity_by_period": _with(PRODUCT)
    + "\nUNION ALL\n".join(
        f"""SELECT '{p}' AS period, CAST(date_trunc('{p}', ts) AS DATE) AS start,
       COUNT(*) AS events_count, COUNT(DISTINCT user_id) AS active_users FROM ev GROUP BY ALL"""
        for p in ("day", "month", "year")
    ),
    "amount_quantiles": _with(PRODUCT, PAYMENTS)
    + """, ranked AS (
  SELECT event, channel, amount, ROW_NUMBER() OVER (PARTITION BY event, channel ORDER BY amount) AS rn,
         COUNT(*) OVER (PARTITION BY event, channel) AS n
  FROM pay JOIN (SELECT DISTINCT user_id, channel FROM ev WHERE event_type = 'registration') USING (user_id)
)
"""
    + _RANKED,
    "hierarchy_activity": _with(ADS, LAST_ADS)
    + f"""SELECT CASE GROUPING(campaign_id, adset_id, ad_id) WHEN 7 THEN 'source' WHEN 3 THEN 'campaign' WHEN 1 THEN 'adset'
                                                         ELSE 'ad' END AS level,
       source AS channel, campaign_id, adset_id, ad_id, COUNT(DISTINCT ad_id) AS active_ads,
       COUNT(DISTINCT day) AS active_days, {_round("SUM(spend) / 100", 2)} AS total_spend,
       {_round(_div("SUM(spend) / 100", "SUM(registrations) / 100"), 2)} AS cac
FROM last_ad
GROUP BY GROUPING SETS ((source), (source, campaign_id), (source, campaign_id, adset_id),
                        (source, campaign_id, adset_id, ad_id))""",
    "monthly_cac_calendar": _with(ADS, LAST_ADS)
    + f""", per_month AS (
  SELECT source, CAST(date_trunc('month', day) AS DATE) AS month, {_MEASURE_SUMS} FROM last_ad GROUP BY ALL
),
rated AS (SELECT *, {_RATES["cac"]} AS c FROM per_month),
spine AS (
  SELECT source, CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM rated GROUP BY source
),
dense AS (
  SELECT *, LAG(c) OVER (PARTITION BY source ORDER BY month) AS prev,
         LAST_VALUE(c IGNORE NULLS) OVER earlier AS known,
         LAST_VALUE(CASE WHEN c IS NOT NULL THEN month END IGNORE NULLS) OVER earlier AS known_month
  FROM spine LEFT JOIN rated USING (source, month)
  WINDOW earlier AS (PARTITION BY source ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT source AS channel, strftime(month, '%Y-%m') AS month, {_SPEND} AS total_spend, {_round("c", 2)} AS cac,
       {_round("prev", 2)} AS previous_month_cac, {_ratio("c - prev", "prev", 2, 100)} AS change_pct,
       {_round("known", 2)} AS last_known_cac, datediff('month', known_month, month) AS months_since,
       {_ratio("c - known", "known", 2, 100)} AS change_since_last_pct,
       COALESCE(datediff('month', known_month, month) > 1, FALSE) AS gap
FROM dense""",
    "deduplicated_ads": _with(ADS, LAST_ADS)
    + """SELECT source, campaign_id, adset_id, ad_id, day AS "date", """
    + ", ".join(
        f"CAST(CAST({m} AS DECIMAL(20,2)) * CAST(0.01 AS DECIMAL(2,2)) AS DOUBLE) AS {m}"
        for m in MEASURES
    )
    + ", snapshot_ts FROM last_ad",
    "ads_daily_metrics": _with(ADS, LAST_ADS)
    + 'SELECT source, day AS "date", '
    + ", ".join(f"CAST({_scaled_sum(m)} AS DOUBLE) AS daily_{m}" for m in MEASURES)
    + " FROM last_ad GROUP BY source, day",
    "ads_channel_totals": _with(ADS, LAST_ADS)
    + "SELECT source, "
    + ", ".join(f"CAST({_scaled_sum(m)} AS DOUBLE) AS total_{m}" for m in MEASURES)
    + " FROM last_ad GROUP BY source",
    "cac_by_channel": _with(*_ALL)
    + f"""SELECT source AS channel, {_SPEND} AS total_spend, {_RATE_COLUMNS},
       {_round("ltv", 2)} AS ltv_per_reg_user, {_ratio("ltv", _RATES["cac"], 2)} AS ltv_cac
FROM per_source
LEFT JOIN (SELECT channel, {_LTV} AS ltv FROM per_channel) ON channel = source""",
    "monthly_cac_by_channel": _with(ADS, LAST_ADS)
    + f""", per_month AS (
  SELECT source, strftime(day, '%Y-%m') AS month, {_MEASURE_SUMS} FROM last_ad GROUP BY ALL
),
rated AS (
  SELECT *, {_RATES["cac"]} AS c,
         LAG({_RATES["cac"]}) OVER (PARTITION BY source ORDER BY month) AS prev
  FROM per_month
)
SELECT source AS channel, month, {_SPEND} AS total_spend,
       {_round("registrations / 100", 0)} AS registrations, {_RATE_COLUMNS},
       {_round("prev", 2)} AS previous_month_cac,
       {_ratio("c - prev", "prev", 2, 100)} AS cac_mom_change_pct
FROM rated""",
    "cac_by_hierarchy": _with(ADS, LAST_ADS)
    + f""", rolled AS (
  SELECT source, campaign_id, adset_id, ad_id, {_MEASURE_SUMS},
         GROUPING(campaign_id, adset_id, ad_id) AS depth
  FROM last_ad
  GROUP BY GROUPING SETS ((source), (source, campaign_id), (source, campaign_id, adset_id),
                          (source, campaign_id, adset_id, ad_id))
)
SELECT CASE depth WHEN 7 THEN 'source' WHEN 3 THEN 'campaign' WHEN 1 THEN 'adset'
                  ELSE 'ad' END AS level,
       source AS channel, campaign_id, adset_id, ad_id, {_SPEND} AS total_spend, {_RATE_COLUMNS}
FROM rolled""",
    "dedup_check": _with(ADS, LAST_ADS)
    + """SELECT COUNT(*) AS violating_ad_days
FROM (SELECT 1 FROM last_ad GROUP BY ad_id, day HAVING COUNT(*) > 1)""",
    "coverage_three_sources": _with(PRODUCT, PAYMENTS, ADS)
    + "SELECT table_name AS dataset, CAST(earliest_timestamp AS DATE) AS earliest_date,"
    + " CAST(latest_timestamp AS DATE) AS latest_date, days_covered FROM (\n"
    + _span("product_events", "ev")
    + "\nUNION ALL\n"
    + _span("orders", "pay")
    + "\nUNION ALL\n"
    + _span("marketing_ads_raw", "(SELECT CAST(day AS TIMESTAMP) AS ts FROM ad)")
    + ")",
    "spend_scale_check": _with(ADS, LAST_ADS, SOURCES)
    + f"""SELECT source AS channel, {_money("spend")} AS raw_spend, expected AS expected_spend,
       {_ratio("spend", "expected", 2)} AS scale_ratio
FROM per_source
LEFT JOIN (VALUES ('tiktok', 15000::DOUBLE), ('meta', 50000::DOUBLE), ('google', 15000::DOUBLE))
  AS e(name, expected) ON name = source""",
    "registration_reconciliation": _with(PRODUCT, ADS, LAST_ADS) + _reconciled("ev", "last_ad"),
    "registration_reconciliation_shared_period": _with(PRODUCT, ADS, LAST_ADS)
    + """, period AS (
  SELECT GREATEST((SELECT MIN(CAST(ts AS DATE)) FROM ev), (SELECT MIN(day) FROM ad)) AS first_day,
         LEAST((SELECT MAX(CAST(ts AS DATE)) FROM ev), (SELECT MAX(day) FROM ad)) AS last_day
),
ev_shared AS (
  SELECT * FROM ev WHERE CAST(ts AS DATE) >= (SELECT first_day FROM period)
                     AND CAST(ts AS DATE) <= (SELECT last_day FROM period)
),
ad_shared AS (
  SELECT * FROM last_ad WHERE day >= (SELECT first_day FROM period)
                          AND day <= (SELECT last_day FROM period)
)"""
    + _reconciled("ev_shared", "ad_shared"),
    "product_funnel": _with(PRODUCT)
    + ", counted AS (SELECT "
    + ", ".join(
        f"""COUNT(DISTINCT user_id) FILTER (WHERE event_type = '{m}') AS "{m}\""""
        for m in _MILESTONES
    )
    + " FROM ev)\n"
    + _funnel_rows(
        "counted",
        [(n, f'"{c}"', p and f'"{p}"') for n, c, p in _chain(_MILESTONES)],
        "users",
    ),
    "acquisition_funnel": _with(ADS, LAST_ADS)
    + ", totals AS (SELECT source AS channel, "
    + ", ".join(f"CAST({_scaled_sum(m)} AS DOUBLE) AS {m}" for m in MEASURES[1:])
    + " FROM last_ad GROUP BY source)\n"
    + _funnel_rows("totals", _chain(list(MEASURES[1:])), "value", by="channel, "),
    "monetization_funnel": _with(PRODUCT, PAYMENTS, USERS, CHANNELS)
    + _funnel_rows(
        "per_channel",
        [
            ("registered_users", "registered", None),
            ("buyers", "purchase_users", "registered"),
            ("rebill_users", "rebill_users", "purchase_users"),
            ("upsell_users", "upsell_users", "purchase_users"),
        ],
        "users",
        by="channel, ",
        overall=False,
    ),
    "kpi_cards": _with(*_ALL)
    + f""", blended AS (
  SELECT SUM(registered) AS registered, SUM(revenue) AS revenue,
         {", ".join(
             f"SUM({k}_{part}) AS {k}_{part}" for k in KINDS for part in ("users", "events", "revenue")
         )}
  FROM per_channel
),
spent AS (SELECT SUM(spend) AS spend, SUM(registrations) AS registrations FROM per_source)
SELECT {_money("revenue")} AS total_revenue_6m, {_SPEND} AS total_spend,
       {_round(_RATES["cac"], 2)} AS cac, {_ratio(_LTV, _RATES["cac"], 2)} AS ltv_cac
FROM blended, spent""",
    "unit_economics_by_channel": _with(*_ALL)
    + _ECONOMICS
    + "\nSELECT *, ltv_cac >= 1 AS above_break_even FROM economics",
    "channel_ranking": _with(*_ALL)
    + _ECONOMICS
    + """, asked AS (
  SELECT 'lowest_cac' AS metric, channel, cac AS value, -cac AS score FROM economics
  UNION ALL SELECT 'best_ltv_cac', channel, ltv_cac, ltv_cac FROM economics
  UNION ALL SELECT 'highest_ltv', channel, ltv_6m_per_registered_user,
                   ltv_6m_per_registered_user FROM economics
  UNION ALL SELECT 'largest_revenue', channel, total_revenue_6m, total_revenue_6m FROM economics
)
SELECT metric, RANK() OVER (PARTITION BY metric ORDER BY score DESC NULLS LAST, channel) AS rank,
       channel, value
FROM asked""",
}

ORACLE["incremental_ads"] = ORACLE["deduplicated_ads"]
