"""Oracle SQL (DuckDB dialect) for the registered queries.

Each query is written in the shape of the original job (separate scans per
count, row_number windows, IN subqueries) over the same source views, so it
checks the fused Spark plans independently. The source views are prepended as
CTEs over the driver's base tables. Bounds are the default ``Params``.
"""

from __future__ import annotations

from sendwatch.functions.predicates import COMPLAINT_TAGS

SOURCE_VIEWS = r"""
messages AS (
  SELECT event_id AS sid, user_id AS account_id, ts AS sent_date, ts AS date_created,
         ts AS date_updated, CAST(ts AS date) AS data_load_date,
         CASE event_type WHEN 'purchase' THEN 'DELIVERED' WHEN 'view' THEN 'SENT'
              WHEN 'error' THEN 'UNDELIVERED' WHEN 'signup' THEN 'FAILED' ELSE 'RECEIVED' END AS status,
         CASE k % 10 WHEN 0 THEN 30003 WHEN 1 THEN 30005 WHEN 2 THEN 21614 WHEN 3 THEN 30007
              WHEN 4 THEN 30008 WHEN 5 THEN 21610 WHEN 6 THEN 30002 ELSE 0 END AS error_code,
         CASE WHEN k >= 90 THEN NULL ELSE CAST(floor(k / 10) AS int) END AS flags,
         CASE event_id % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'AU'
              WHEN 4 THEN 'FR' WHEN 5 THEN 'DE' END AS from_cc,
         CASE CAST(floor(event_id / 7) AS bigint) % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB'
              WHEN 3 THEN 'AU' WHEN 4 THEN 'IN' END AS to_cc,
         CASE (user_id + event_id) % 4 WHEN 0 THEN 'LC' WHEN 1 THEN 'SC' WHEN 2 THEN 'AL' END AS from_type
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) e),
bodies AS (
  SELECT e.event_id AS sid, b.text AS body
  FROM events e JOIN benchmark b
    ON CASE WHEN e.event_id % 3 = 0 THEN e.user_id % 40 ELSE e.event_id % 45 END = b.item_id),
complaints AS (
  SELECT o_orderkey AS id, CAST(floor(o_custkey / 10) AS bigint) AS account_id,
         TIMESTAMP '2023-12-30 00:00:00' + (o_orderkey % 34) * INTERVAL '1' DAY
           + (o_orderkey % 24) * INTERVAL '1' HOUR AS processed_ts
  FROM orders WHERE o_orderstatus = 'F'),
optout_log AS (
  SELECT o_orderkey AS id, CAST(floor(o_custkey / 10) AS bigint) AS account_id,
         CAST(o_orderkey % 2 AS int) AS allowed,
         concat(CASE WHEN o_orderkey % 5 = 0 THEN 'MG' ELSE '+1' END, CAST(o_orderkey AS varchar)) AS sender,
         TIMESTAMP '2023-12-30 00:00:00' + (o_orderkey % 34) * INTERVAL '1' DAY
           + (o_orderkey % 24) * INTERVAL '1' HOUR AS updated_ts
  FROM orders WHERE o_orderstatus = 'O'),
audit_events AS (
  SELECT o_orderkey AS event_id, CAST(floor(o_custkey / 10) AS bigint) AS account_id,
         CASE WHEN o_orderkey % 6 = 0 THEN 'Account suspended' ELSE 'Account reactivated' END AS event_name,
         CASE CAST(floor(o_orderkey / 6) AS bigint) % 8 WHEN 0 THEN 'category: AUP' WHEN 1 THEN 'category: FRAUD'
              WHEN 2 THEN 'category: CUSTOMER REQUEST' WHEN 3 THEN 'Account suspended'
              WHEN 4 THEN 'parent_suspended' WHEN 5 THEN 'manual review'
              WHEN 6 THEN 'Account suspended VIA suspension trigger' END AS details,
         TIMESTAMP '2024-01-01 00:00:00' + (CAST(floor(o_orderkey / 6) AS bigint) % 31) * INTERVAL '1' DAY
           + (o_orderkey % 86400) * INTERVAL '1' SECOND AS date_created
  FROM orders WHERE o_orderstatus = 'P'),
accounts AS (
  SELECT c_custkey AS sid,
         CASE c_custkey % 12 WHEN 2 THEN c_custkey - 1 WHEN 4 THEN c_custkey - 1 WHEN 5 THEN c_custkey - 2
              WHEN 7 THEN c_custkey - 1 WHEN 8 THEN c_custkey - 2 WHEN 9 THEN c_custkey - 3
              WHEN 10 THEN c_custkey - 4 WHEN 11 THEN c_custkey - 5 END AS parent_sid,
         concat(c_mktsegment, ' ', c_name) AS friendly_name,
         TIMESTAMP '2019-01-01 00:00:00' + ((c_custkey * 37) % 1800) * INTERVAL '1' DAY AS date_created
  FROM customer),
account_flags AS (SELECT c_custkey AS account_id, c_custkey % 17 = 0 AS is_internal FROM customer),
customer_link AS (
  SELECT CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE c_custkey END AS account_id,
         c_custkey % 300 AS customer_id FROM customer),
crm_accounts AS (
  SELECT c_custkey AS customer_id FROM customer WHERE c_custkey < 300
  UNION ALL SELECT c_custkey FROM customer WHERE c_custkey < 300 AND c_custkey % 12 = 5),
isv_list AS (SELECT s_suppkey AS id FROM supplier),
cannabis_list AS (SELECT c_custkey AS sid FROM customer WHERE c_mktsegment = 'FURNITURE'),
risky_list AS (SELECT c_custkey AS sid FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0),
tickets AS (
  SELECT doc_id AS id, (doc_id * 7) % 150 AS account_id,
         string_split(CASE doc_id % 6 WHEN 0 THEN 'vip,carrier_complaint__sms/voice__spam_abo'
              WHEN 1 THEN 'consumer__spam_abo'
              WHEN 2 THEN 'carrier_complaint__political_abo,consumer__other_abo'
              WHEN 3 THEN 'billing' WHEN 4 THEN 'consumer__harassment_abo,x'
              ELSE 'carrier_complaint__sms/voice__fraud_abo' END, ',') AS tags,
         TIMESTAMP '2023-12-31 00:00:00' + (doc_id % 33) * INTERVAL '1' DAY
           + (doc_id % 24) * INTERVAL '1' HOUR AS created_at,
         TIMESTAMP '2022-01-01 00:00:00' + ((doc_id * 13) % 900) * INTERVAL '1' DAY AS updated_at,
         doc_id % 30 AS group_id
  FROM documents),
ticket_groups AS (SELECT CAST(n_nationkey AS bigint) AS id FROM nation)
"""

# reusable fragments (DuckDB)
NOT_FLAGGED = "NOT coalesce((flags & 1) >= 1, false)"
INTERNAL_FREE = "(SELECT account_id FROM account_flags WHERE is_internal = false)"
WEEK = "strftime(date_trunc('week', {c}), '%Y-%m-%d')"
UNREACH = "((error_code >= 30003 AND error_code <= 30006) OR error_code = 21614)"


def _w(c: str) -> str:
    return WEEK.format(c=c)


Q: dict[str, str] = {}

PHONE_SENDER = "(sender IS NULL OR sender NOT LIKE 'MG%')"
KEEP = f"{NOT_FLAGGED}"

# --- account rates (one month) ---------------------------------------------
Q["account_rates"] = f"""
month_msgs AS (
  SELECT account_id, error_code FROM messages
  WHERE date_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
    AND data_load_date >= DATE '2024-01-01' AND {KEEP}),
sends AS (
  SELECT account_id, count(*) AS attempted,
         nullif(count(*) FILTER (WHERE error_code = 0), 0) AS delivered
  FROM month_msgs GROUP BY account_id),
outs AS (
  SELECT o.account_id, count(*) AS optouts FROM optout_log o
  SEMI JOIN account_flags f ON f.account_id = o.account_id AND NOT f.is_internal
  WHERE o.allowed = 0 AND {PHONE_SENDER}
    AND o.updated_ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
  GROUP BY o.account_id),
reports AS (
  SELECT c.account_id, count(*) AS n_7726 FROM complaints c
  SEMI JOIN account_flags f ON f.account_id = c.account_id AND NOT f.is_internal
  WHERE CAST(c.processed_ts AS date) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
  GROUP BY c.account_id)
SELECT s.account_id, s.attempted, s.delivered, o.optouts, r.n_7726
FROM sends s LEFT JOIN outs o USING (account_id) LEFT JOIN reports r USING (account_id)
"""

Q["account_error_counts"] = f"""
SELECT account_id,
  count(*) FILTER (WHERE {UNREACH}) AS unreachable,
  count(*) FILTER (WHERE error_code = 30007) AS n_30007,
  count(*) FILTER (WHERE error_code = 30008) AS n_30008,
  count(*) FILTER (WHERE error_code = 21610) AS n_21610,
  count(*) FILTER (WHERE from_type = 'LC') AS is_LC,
  count(*) FILTER (WHERE from_type = 'SC') AS is_SC,
  count(*) FILTER (WHERE from_type = 'AL') AS is_AL
FROM messages
WHERE date_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
  AND data_load_date >= DATE '2024-01-01' AND {KEEP}
GROUP BY account_id
"""

# trimmed snapshot: send day strictly inside (lo, hi)
SNAPSHOT = """
snap AS (
  SELECT account_id, sid, status, sent_date, error_code, from_type, from_cc, to_cc FROM messages
  WHERE sent_date >= DATE '{lo}' + INTERVAL 1 DAY AND sent_date < DATE '{hi}')
"""
SNAP_MONTH = SNAPSHOT.format(lo="2024-01-02", hi="2024-01-30")

Q["message_snapshot"] = SNAP_MONTH + "SELECT * FROM snap"

WEEK_RATES = SNAP_MONTH + f""",
weekly AS (
  SELECT account_id, {_w('sent_date')} AS wk, count(*) AS total,
    count(*) FILTER (WHERE {UNREACH}) AS unreachable,
    count(*) FILTER (WHERE error_code = 30007) AS n_30007,
    count(*) FILTER (WHERE error_code = 30002) AS n_30002,
    count(*) FILTER (WHERE error_code = 21610) AS n_21610
  FROM snap GROUP BY ALL),
reports_wk AS (
  SELECT account_id, {_w('processed_ts')} AS wk, count(*) AS n_7726 FROM complaints
  WHERE processed_ts >= DATE '2024-01-03' AND processed_ts < DATE '2024-01-30'
  GROUP BY ALL),
outs_wk AS (
  SELECT account_id, {_w('updated_ts')} AS wk, count(*) AS optouts FROM optout_log
  WHERE allowed = 0 AND {PHONE_SENDER}
    AND updated_ts > TIMESTAMP '2024-01-02' AND updated_ts < TIMESTAMP '2024-01-30'
  GROUP BY ALL),
week_rates AS (
  SELECT w.account_id, w.wk, w.total, w.unreachable, w.n_30007, w.n_30002, w.n_21610,
    coalesce(r.n_7726, 0) AS n_7726, coalesce(o.optouts, 0) AS optouts,
    100.0::double * w.unreachable / w.total AS unreachable_pct,
    100.0::double * w.n_30007 / w.total AS n_30007_pct,
    100.0::double * w.n_30002 / w.total AS n_30002_pct,
    100.0::double * w.n_21610 / w.total AS n_21610_pct,
    100.0::double * coalesce(r.n_7726, 0) / w.total AS n_7726_pct,
    100.0::double * coalesce(o.optouts, 0) / w.total AS optouts_pct
  FROM weekly w
  LEFT JOIN reports_wk r USING (account_id, wk)
  LEFT JOIN outs_wk o USING (account_id, wk))
"""
Q["week_unwanted_rates"] = WEEK_RATES + "SELECT * FROM week_rates"


def _mode_cte(trait: str) -> str:
    """Most frequent non-NULL value per account-week (ties: smallest value)."""
    return f"""
mode_{trait} AS (
  SELECT account_id, wk, {trait} FROM (
    SELECT account_id, {_w('sent_date')} AS wk, {trait}, count(*) AS n
    FROM snap WHERE {trait} IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY account_id, wk ORDER BY n DESC, {trait}) = 1)"""


MODES_AND_TRAITS = ",".join(_mode_cte(t) for t in ["from_cc", "to_cc", "from_type", "status"]) + f""",
volume AS (SELECT account_id, {_w('sent_date')} AS wk, count(*) AS ct FROM snap GROUP BY ALL),
traits_v3 AS (
  SELECT account_id, wk, a.from_cc, b.to_cc, c.from_type, d.status, v.ct
  FROM mode_from_cc a
  LEFT JOIN mode_to_cc b USING (account_id, wk)
  LEFT JOIN mode_from_type c USING (account_id, wk)
  LEFT JOIN mode_status d USING (account_id, wk)
  LEFT JOIN volume v USING (account_id, wk))
"""
WEEK_TRAITS = SNAP_MONTH + "," + MODES_AND_TRAITS
Q["week_dominant_traits"] = WEEK_TRAITS + "SELECT * FROM traits_v3"
Q["week_volume"] = SNAP_MONTH + f"SELECT account_id, {_w('sent_date')} AS wk, count(*) AS ct FROM snap GROUP BY ALL"

# --- account traits --------------------------------------------------------
AGE = "CAST(datesub('month', CAST(date_created AS date), DATE '2024-01-31') AS int)"
TRAITS = f"""
isv_link AS (
  SELECT l.account_id, l.customer_id, CAST((i.id IS NOT NULL) AS int) AS isv
  FROM customer_link l LEFT JOIN (SELECT DISTINCT id FROM isv_list) i ON i.id = l.customer_id
  LEFT JOIN crm_accounts c ON c.customer_id = l.customer_id
  WHERE l.account_id IS NOT NULL AND l.account_id <> -1),
live AS (SELECT *, coalesce(parent_sid, sid) AS root FROM accounts
         WHERE date_created < TIMESTAMP '2024-01-31'),
fam AS (SELECT root, count(DISTINCT sid) - 1 AS num_sub FROM live GROUP BY root),
traits AS (
  SELECT l.parent_sid, l.sid, l.root AS family_id, {AGE} AS age,
    CAST((l.parent_sid IS NOT NULL) AS int) AS parent, f.num_sub, coalesce(x.isv, 0) AS isv,
    CASE WHEN {AGE} IS NULL THEN '26-47' WHEN {AGE} <= 11 THEN '0-11' WHEN {AGE} <= 26 THEN '11-26'
         WHEN {AGE} <= 47 THEN '26-47' ELSE '> 47' END AS age_cat,
    CASE f.num_sub WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '> 1' END AS num_sub_cat
  FROM live l LEFT JOIN fam f USING (root) LEFT JOIN isv_link x ON x.account_id = l.root)
"""
Q["account_traits"] = TRAITS + "SELECT * FROM traits"
Q["isv_flag"] = TRAITS + "SELECT * FROM isv_link"
Q["family_size"] = TRAITS + "SELECT DISTINCT sid, coalesce(num_sub, 0) + 1 AS fam_size FROM traits"
Q["default_name_flag"] = """
SELECT sid, friendly_name, CAST(coalesce(contains(friendly_name, 'BUILDING'), false) AS int) AS default_name
FROM accounts
"""
Q["age_tile_cutpoints"] = f"""
SELECT DISTINCT age FROM (
  SELECT {AGE} AS age FROM accounts WHERE date_created < TIMESTAMP '2024-01-31')
QUALIFY ntile(100) OVER (ORDER BY age) IN (25, 50, 75)
"""
Q["subaccount_tile_cutpoints"] = """
SELECT DISTINCT num_sub FROM (
  SELECT coalesce(parent_sid, sid) AS root, count(DISTINCT sid) - 1 AS num_sub
  FROM accounts WHERE date_created < TIMESTAMP '2024-01-31' GROUP BY root)
WHERE num_sub > 0
QUALIFY ntile(100) OVER (ORDER BY num_sub) IN (25, 50, 75)
"""

Q["week_wide"] = WEEK_RATES + "," + MODES_AND_TRAITS + "," + TRAITS + """
SELECT u.*, r.from_cc, r.to_cc, r.from_type, r.status, r.ct,
       a.parent_sid, a.sid, a.family_id, a.age, a.parent, a.num_sub, a.isv, a.age_cat, a.num_sub_cat
FROM week_rates u
JOIN traits_v3 r USING (account_id, wk)
JOIN traits a ON a.sid = u.account_id
"""


def _period_wide(lo: str, hi: str) -> str:
    pct_cols = ["unreachable", "n_30007", "n_30008", "n_21610", "n_7726", "optouts",
                "from_US", "from_CA", "from_GB", "from_AU", "from_FR",
                "to_US", "to_CA", "to_GB", "to_AU", "to_IN", "is_LC", "is_SC", "is_AL",
                "delivered", "undelivered", "sent"]
    pcts = ",\n    ".join(f"100.0::double * {c} / total AS {c}_pct" for c in pct_cols)
    cnt = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"
    counts = ",\n    ".join(
        [cnt(UNREACH, "unreachable")] + [cnt(f"error_code = {c}", f"n_{c}") for c in (30007, 30008, 21610)]
        + [cnt(f"from_cc = '{c}'", f"from_{c}") for c in ("US", "CA", "GB", "AU", "FR")]
        + [cnt(f"to_cc = '{c}'", f"to_{c}") for c in ("US", "CA", "GB", "AU", "IN")]
        + [cnt(f"from_type = '{t}'", f"is_{t}") for t in ("LC", "SC", "AL")]
        + [cnt(f"status = '{v}'", n) for n, v in (("delivered", "DELIVERED"), ("undelivered", "UNDELIVERED"),
                                                   ("sent", "SENT"))])
    return SNAPSHOT.format(lo=lo, hi=hi) + f""",
external AS (SELECT account_id FROM account_flags WHERE NOT is_internal),
per_account AS (
  SELECT account_id, count(*) AS total,
    {counts}
  FROM snap SEMI JOIN external USING (account_id)
  WHERE status <> 'RECEIVED'
  GROUP BY account_id),
reports_p AS (
  SELECT account_id, count(*) AS n_7726 FROM complaints SEMI JOIN external USING (account_id)
  WHERE processed_ts >= DATE '{lo}' + INTERVAL 1 DAY AND processed_ts < DATE '{hi}'
  GROUP BY account_id),
outs_p AS (
  SELECT account_id, count(*) AS optouts FROM optout_log SEMI JOIN external USING (account_id)
  WHERE allowed = 0 AND {PHONE_SENDER}
    AND updated_ts > TIMESTAMP '{lo}' AND updated_ts < TIMESTAMP '{hi}'
  GROUP BY account_id),
joined AS (
  SELECT p.*, coalesce(r.n_7726, 0) AS n_7726, coalesce(o.optouts, 0) AS optouts
  FROM per_account p LEFT JOIN reports_p r USING (account_id) LEFT JOIN outs_p o USING (account_id)),
u AS (SELECT *, {pcts} FROM joined),
""" + TRAITS + """
SELECT u.*, a.* FROM u JOIN traits a ON a.sid = u.account_id
WHERE u.account_id IN (SELECT account_id FROM external)
"""


Q["account_wide_p1"] = _period_wide("2024-01-02", "2024-01-15")
Q["account_wide_p2"] = _period_wide("2024-01-17", "2024-01-30")


# --- suspensions -----------------------------------------------------------
def _category_sql(category: str, other: str) -> str:
    """Tagged with the category, or carrying none of the known tags (NULL
    details never qualify)."""
    others = " OR ".join(f"contains(details, '{m}')" for m in (
        "parent_suspended", "suspended_by_parent", "Account suspended VIA suspension trigger",
        f"category: {other}", "category: CUSTOMER REQUEST"))
    return (f"details IS NOT NULL AND (contains(details, 'category: {category}') "
            f"OR NOT ({others} OR details = 'Account suspended'))")


def _suspension(category: str, other: str, lookback: str, first: str = "2024-01-08",
                last: str = "2024-01-30") -> str:
    return f"""
latest AS (
  SELECT account_id, date_created, details FROM audit_events WHERE event_name = 'Account suspended'
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY date_created DESC, event_id DESC) = 1),
hit AS (
  SELECT account_id, CAST(date_created AS date) AS sday FROM latest
  WHERE date_created BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'
    AND CAST(date_created AS date) BETWEEN DATE '{first}' AND DATE '{last}'
    AND {_category_sql(category, other)}),
daily AS (
  SELECT account_id, CAST(date_created AS date) AS d, count(*) AS n FROM messages
  WHERE {KEEP} AND error_code = 0
    AND date_created >= TIMESTAMP '{lookback}' AND data_load_date >= DATE '{lookback}'
  GROUP BY ALL)
"""


Q["aup_messages"] = _suspension("AUP", "FRAUD", "2024-01-01") + """
SELECT h.account_id, CAST(sum(n) AS bigint) AS aup
FROM hit h JOIN daily m ON m.account_id = h.account_id AND m.d BETWEEN h.sday - 7 AND h.sday
GROUP BY h.account_id
"""
Q["fraud_messages"] = _suspension("FRAUD", "AUP", "2023-01-07") + """
SELECT h.account_id, CAST(max(c.sid IS NOT NULL) AS int) AS cannabis, CAST(sum(n) AS bigint) AS fraud
FROM hit h JOIN daily m ON m.account_id = h.account_id AND m.d BETWEEN h.sday - 7 AND h.sday
LEFT JOIN (SELECT DISTINCT sid FROM cannabis_list) c ON c.sid = h.account_id
GROUP BY h.account_id
"""

# --- top body per risky account ---------------------------------------------
Q["top_body_per_account"] = f"""
risky_msgs AS (
  SELECT m.account_id, m.sid FROM messages m
  WHERE m.account_id IN (SELECT sid FROM risky_list) AND {KEEP} AND m.error_code = 0
    AND m.date_created >= TIMESTAMP '2024-01-01' AND m.date_created < TIMESTAMP '2024-02-01'
    AND m.data_load_date >= DATE '2024-01-01' AND m.data_load_date < DATE '2024-02-01'),
per_body AS (
  SELECT r.account_id, b.body, count(DISTINCT r.sid) AS n_sids
  FROM risky_msgs r LEFT JOIN bodies b ON b.sid = r.sid GROUP BY ALL)
SELECT account_id, body, n_sids FROM per_body
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY n_sids DESC, body ASC NULLS LAST) = 1
"""

# --- complaints ------------------------------------------------------------
PT = "timezone('America/Los_Angeles', timezone('UTC', {c}))"
JOINED = "array_to_string(t.tags, ',')"
IS_COMPLAINT = " OR ".join(f"contains({JOINED}, '{p}')" for p in COMPLAINT_TAGS)
# rolling ticket window for as_of 2024-01-30 (a Tuesday): [Monday - 89 weeks, Monday + 1 week)
UPD_WINDOW = (f"{PT.format(c='t.updated_at')} >= TIMESTAMP '2024-01-29' - INTERVAL 623 DAY "
              f"AND {PT.format(c='t.updated_at')} < TIMESTAMP '2024-01-29' + INTERVAL 7 DAY")


def _tickets(created_to: str | None) -> str:
    upper = f"AND {PT.format(c='t.created_at')} <= TIMESTAMP '{created_to}'" if created_to else ""
    return f"""
tix AS (
  SELECT t.account_id, {PT.format(c='t.created_at')} AS created_pt,
    contains({JOINED}, 'carrier_complaint') AS carrier,
    NOT contains({JOINED}, 'carrier_complaint') AND contains({JOINED}, 'consumer__') AS consumer
  FROM tickets t LEFT JOIN ticket_groups g ON g.id = t.group_id
  WHERE {PT.format(c='t.created_at')} >= TIMESTAMP '2024-01-01' {upper}
    AND {UPD_WINDOW} AND ({IS_COMPLAINT}))"""


RATE = ("(coalesce(n_7726, 0) + coalesce(complaints_carrier, 0) + coalesce(complaints_consumer, 0))"
        " / CAST(denom AS double) AS complaint_rate")

Q["complaint_rate_account"] = _tickets("2024-01-30") + f""",
tix_acct AS (
  SELECT account_id, nullif(count(*) FILTER (WHERE carrier), 0) AS complaints_carrier,
         nullif(count(*) FILTER (WHERE consumer), 0) AS complaints_consumer
  FROM tix GROUP BY account_id),
reports AS (
  SELECT account_id, count(*) AS n_7726 FROM complaints
  WHERE processed_ts >= DATE '2024-01-01' GROUP BY account_id),
attempts AS (
  SELECT account_id, count(*) AS denom FROM messages
  WHERE {KEEP} AND date_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
    AND data_load_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
  GROUP BY account_id)
SELECT account_id, n_7726, complaints_carrier, complaints_consumer, {RATE}
FROM attempts LEFT JOIN tix_acct USING (account_id) LEFT JOIN reports USING (account_id)
"""

Q["complaint_rate_month"] = _tickets(None) + f""",
tix_month AS (
  SELECT strftime(created_pt, '%Y-%m') AS month,
         nullif(count(*) FILTER (WHERE carrier), 0) AS complaints_carrier,
         nullif(count(*) FILTER (WHERE consumer), 0) AS complaints_consumer
  FROM tix GROUP BY month),
reports AS (
  SELECT strftime(processed_ts, '%Y-%m') AS month, count(*) AS n_7726 FROM complaints
  WHERE processed_ts >= DATE '2024-01-01' GROUP BY month),
delivered AS (
  SELECT strftime(date_created, '%Y-%m') AS month, count(*) AS denom FROM messages
  WHERE {KEEP} AND error_code = 0
    AND date_created >= TIMESTAMP '2024-01-01' AND data_load_date >= DATE '2024-01-01'
  GROUP BY month)
SELECT month, n_7726, complaints_carrier, complaints_consumer, {RATE}
FROM delivered LEFT JOIN tix_month USING (month) LEFT JOIN reports USING (month)
"""


def _compose(body: str) -> str:
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + SOURCE_VIEWS.strip() + "\n" + body
    return "WITH " + SOURCE_VIEWS.strip() + ",\n" + body


def oracle_sql() -> dict[str, str]:
    return {name: _compose(body) for name, body in Q.items()}


# --- feature assembly (period 1 / period 2) ---------------------------------
def _rates_block(p: str, first: str, last: str) -> str:
    return f"""
{p}_opt AS (
  SELECT account_id, count(*) AS optouts FROM optout_log
  WHERE allowed = 0 AND NOT coalesce(sender LIKE 'MG%', false)
    AND updated_ts >= TIMESTAMP '{first}' AND updated_ts <= TIMESTAMP '{last}'
    AND account_id IN {INTERNAL_FREE} GROUP BY 1),
{p}_spam AS (
  SELECT account_id, count(*) AS n_7726 FROM complaints
  WHERE CAST(processed_ts AS date) >= DATE '{first}' AND CAST(processed_ts AS date) <= DATE '{last}'
    AND account_id IN {INTERNAL_FREE} GROUP BY 1),
{p}_msg AS (
  SELECT * FROM messages
  WHERE date_created >= TIMESTAMP '{first}' AND date_created <= TIMESTAMP '{last}'
    AND data_load_date >= DATE '{first}' AND {NOT_FLAGGED}),
{p}_att AS (SELECT account_id, count(*) AS attempted FROM {p}_msg GROUP BY 1),
{p}_dlv AS (SELECT account_id, count(*) AS delivered FROM {p}_msg WHERE error_code = 0 GROUP BY 1),
{p}_err AS (
  SELECT account_id,
    count(*) FILTER (WHERE {UNREACH}) AS unreachable,
    count(*) FILTER (WHERE error_code = 30007) AS n_30007,
    count(*) FILTER (WHERE error_code = 30008) AS n_30008,
    count(*) FILTER (WHERE error_code = 21610) AS n_21610,
    count(*) FILTER (WHERE from_type = 'LC') AS is_LC,
    count(*) FILTER (WHERE from_type = 'SC') AS is_SC,
    count(*) FILTER (WHERE from_type = 'AL') AS is_AL
  FROM {p}_msg GROUP BY 1),
{p}_rates AS (
  SELECT a.account_id, a.attempted, d.delivered, o.optouts, s.n_7726,
    e.unreachable, e.n_30007, e.n_30008, e.n_21610, e.is_LC, e.is_SC, e.is_AL
  FROM {p}_att a LEFT JOIN {p}_dlv d ON d.account_id = a.account_id
  LEFT JOIN {p}_opt o ON o.account_id = a.account_id
  LEFT JOIN {p}_spam s ON s.account_id = a.account_id
  LEFT JOIN {p}_err e ON e.account_id = a.account_id)"""


def _susp_block(p: str, category: str, other: str, lookback: str, first: str, last: str) -> str:
    return f"""
{p}_last AS (
  SELECT * FROM (
    SELECT date_created, details, account_id,
      row_number() OVER (PARTITION BY account_id ORDER BY date_created DESC, event_id DESC) AS rn
    FROM audit_events WHERE event_name = 'Account suspended') t WHERE rn = 1),
{p}_es AS (
  SELECT account_id AS sid, CAST(date_created AS date) AS sday FROM {p}_last
  WHERE date_created >= TIMESTAMP '{first}' AND date_created <= TIMESTAMP '{last}'
    AND {_category_sql(category, other)}
    AND CAST(date_created AS date) BETWEEN DATE '{first}' AND DATE '{last}'),
{p}_msgs AS (
  SELECT account_id, CAST(date_created AS date) AS d, count(*) AS ct FROM messages
  WHERE account_id IN (SELECT sid FROM {p}_es) AND {NOT_FLAGGED} AND error_code = 0
    AND date_created >= TIMESTAMP '{lookback}' AND data_load_date >= DATE '{lookback}'
  GROUP BY 1, 2),
{p} AS (
  SELECT m.account_id, CAST(sum(ct) AS bigint) AS {category.lower()} FROM {p}_msgs m
  JOIN {p}_es e ON e.sid = m.account_id
  WHERE d BETWEEN e.sday - INTERVAL '7' DAY AND e.sday GROUP BY 1)"""


FILL = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [
    "attempted", "delivered", "optouts", "n_7726", "unreachable", "n_30007", "n_30008", "n_21610",
    "is_LC", "is_SC", "is_AL", "aup", "cannabis", "fraud", "fam_size", "age", "parent", "isv",
    "default_name"])
FRACS = """CAST(optouts AS double) / CAST(delivered AS double) AS optout_frac,
    CAST(n_7726 AS double) / CAST(delivered AS double) AS frac_7726,
    CAST(n_30008 AS double) / CAST(attempted AS double) AS frac_30008,
    CAST(n_30007 AS double) / CAST(attempted AS double) AS frac_30007,
    CAST(n_21610 AS double) / CAST(attempted AS double) AS frac_21610,
    CAST(unreachable AS double) / CAST(attempted AS double) AS unreachable_frac,
    CAST(aup AS double) / CAST(attempted AS double) AS aup_frac,
    CAST(fraud AS double) / CAST(attempted AS double) AS fraud_frac"""
FEATURE_COLS = ("account_id, attempted, delivered, optouts, n_7726, unreachable, n_30007, n_30008, n_21610, "
                "is_LC, is_SC, is_AL, aup, cannabis, fraud, fam_size, age, parent, isv, default_name, "
                "optout_frac, frac_7726, frac_30008, frac_30007, frac_21610, unreachable_frac, aup_frac, "
                "fraud_frac")

FEATURES = TRAITS + "," + _rates_block("r1", "2024-01-01", "2024-01-15") + "," \
    + _susp_block("aup1", "AUP", "FRAUD", "2024-01-01", "2024-01-08", "2024-01-15") + "," \
    + _susp_block("fraud1", "FRAUD", "AUP", "2023-01-07", "2024-01-08", "2024-01-15") + "," \
    + _rates_block("r2", "2024-01-16", "2024-01-30") + "," \
    + _susp_block("aup2", "AUP", "FRAUD", "2024-01-09", "2024-01-16", "2024-01-30") + "," \
    + _susp_block("fraud2", "FRAUD", "AUP", "2023-01-15", "2024-01-16", "2024-01-30") + f""",
famsize AS (SELECT DISTINCT sid AS account_id, coalesce(num_sub, 0) + 1 AS fam_size FROM traits),
age_x AS (SELECT sid AS account_id, age, parent, isv FROM traits),
names AS (SELECT sid AS account_id, max(CASE WHEN friendly_name LIKE '%BUILDING%' THEN 1 ELSE 0 END) AS default_name
          FROM accounts GROUP BY 1),
merged_p1 AS (
  SELECT r.*, au.aup,
    CASE WHEN fr.account_id IS NULL THEN NULL
         WHEN fr.account_id IN (SELECT sid FROM cannabis_list) THEN 1 ELSE 0 END AS cannabis,
    fr.fraud, fa.fam_size, ag.age, ag.parent, ag.isv, nm.default_name
  FROM r1_rates r
  LEFT JOIN aup1 au ON au.account_id = r.account_id
  LEFT JOIN fraud1 fr ON fr.account_id = r.account_id
  INNER JOIN famsize fa ON fa.account_id = r.account_id
  LEFT JOIN age_x ag ON ag.account_id = r.account_id
  LEFT JOIN names nm ON nm.account_id = r.account_id),
f1 AS (SELECT account_id, {FILL} FROM merged_p1),
g1 AS (SELECT *, {FRACS} FROM f1 WHERE attempted > 15 AND delivered > 1),
features_p1 AS (SELECT {FEATURE_COLS} FROM g1 WHERE aup_frac <= 1 AND fraud_frac <= 1),
j2 AS (
  SELECT r.*,
    CASE WHEN fr.account_id IS NULL THEN NULL
         WHEN fr.account_id IN (SELECT sid FROM cannabis_list) THEN 1 ELSE 0 END AS cannabis,
    fr.fraud, au.aup, nm.default_name, NULL::bigint AS fam_size, NULL::int AS age,
    NULL::int AS parent, NULL::int AS isv
  FROM r2_rates r
  LEFT JOIN fraud2 fr ON fr.account_id = r.account_id
  LEFT JOIN aup2 au ON au.account_id = r.account_id
  LEFT JOIN names nm ON nm.account_id = r.account_id),
f2 AS (SELECT account_id, {FILL} FROM j2),
g2 AS (SELECT * EXCLUDE (fam_size, age, parent, isv), {FRACS} FROM f2
       WHERE delivered > 1 AND attempted > 15),
c2 AS (SELECT * FROM g2 WHERE aup_frac <= 1 AND fraud_frac <= 1),
features_p2 AS (
  SELECT {FEATURE_COLS} FROM c2 INNER JOIN age_x USING (account_id) INNER JOIN famsize USING (account_id))
"""

Q["features_p1"] = FEATURES + "SELECT * FROM features_p1"
Q["features_p2"] = FEATURES + "SELECT * FROM features_p2"

NUMERIC = ["attempted", "delivered", "optouts", "n_7726", "unreachable", "n_30007", "n_30008", "n_21610",
           "is_LC", "is_SC", "is_AL", "aup", "cannabis", "fraud", "fam_size", "age", "parent", "isv",
           "default_name", "optout_frac", "frac_7726", "frac_30008", "frac_30007", "frac_21610",
           "unreachable_frac", "aup_frac", "fraud_frac"]
_DBL = ", ".join(f"CAST({c} AS double) AS {c}" for c in NUMERIC)

Q["describe_features"] = FEATURES + f"""
SELECT column_name, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
FROM (UNPIVOT (SELECT {_DBL} FROM features_p1) ON COLUMNS(*) INTO NAME column_name VALUE value) u
GROUP BY column_name
"""
Q["null_counts"] = FEATURES + f"""
SELECT column_name, non_null, n_rows FROM (
  UNPIVOT (SELECT count(*) AS n_rows, {", ".join(f"count({c}) AS {c}" for c in NUMERIC[:19])} FROM merged_p1)
  ON {", ".join(NUMERIC[:19])} INTO NAME column_name VALUE non_null) u
"""
_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]]
_CORR = ",\n  ".join(
    f"CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL "
    f"ELSE round(corr(CAST({a} AS double), CAST({b} AS double)), 6) END AS \"{a}|{b}\"" for a, b in _PAIRS)
Q["corr_long"] = FEATURES + f"""
SELECT split_part(pair, '|', 1) AS col_a, split_part(pair, '|', 2) AS col_b, corr
FROM (SELECT {_CORR} FROM features_p1) w
UNPIVOT INCLUDE NULLS (corr FOR pair IN ({", ".join(f'"{a}|{b}"' for a, b in _PAIRS)}))
"""


# larger of the Sturges and Freedman-Diaconis counts
AUTO_BINS = """CAST(CASE WHEN count(*) = 0 OR max(v) = min(v) THEN 1 ELSE greatest(ceil(round(log2(count(v)) + 1, 9)),
      CASE WHEN quantile_cont(v, 0.75) = quantile_cont(v, 0.25) THEN 1
           ELSE ceil(round((max(v) - min(v)) / (2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))
                           / pow(count(v), 1.0 / 3)), 9)) END) END AS bigint)"""


def _hist(src: str, expr: str, bins: int | None, lo: str | None = None, hi: str | None = None) -> str:
    count, bins, edges = (AUTO_BINS, "nb", "lo, hi, nb") if bins is None else (bins, bins, "lo, hi")
    nb = f"CAST({bins} AS double)"
    if lo is None:
        rng = f"b AS (SELECT min(v) AS lo, max(v) AS hi, {count} AS nb FROM h)"
        where = ""
    else:
        rng = f"b AS (SELECT CAST({lo} AS double) AS lo, CAST({hi} AS double) AS hi)"
        where = f" AND v >= CAST({lo} AS double) AND v <= CAST({hi} AS double)"
    return f"""
h AS (SELECT CAST({expr} AS double) AS v FROM {src}),
{rng},
binned AS (
  SELECT CASE WHEN hi - lo = 0 THEN CAST(1 AS bigint)
              ELSE least(CAST(floor((v - lo) * {nb} / (hi - lo)) AS bigint) + 1, CAST({bins} AS bigint)) END AS bin,
         {edges}
  FROM h, b WHERE v IS NOT NULL{where})
SELECT bin, round(lo + (hi - lo) * (CAST(bin AS double) - 1.0::double) / {nb}, 6) AS bin_lo,
  round(lo + (hi - lo) * (CAST(bin + 1 AS double) - 1.0::double) / {nb}, 6) AS bin_hi, count(*) AS n
FROM binned GROUP BY bin, {edges}
"""


Q["hist_age"] = FEATURES + "," + _hist("features_p1", "age", None)
Q["hist_unreachable"] = FEATURES + "," + _hist("features_p1", "unreachable_frac", None)
Q["hist_21610"] = FEATURES + "," + _hist("features_p1", "frac_21610", 20)
Q["category_counts"] = FEATURES + """
SELECT feature, value, count(*) AS n FROM (
  UNPIVOT (SELECT CAST(parent AS varchar) AS parent, CAST(isv AS varchar) AS isv,
                  CAST(cannabis AS varchar) AS cannabis FROM features_p1)
  ON parent, isv, cannabis INTO NAME feature VALUE value) u
GROUP BY 1, 2
"""
Q["cohort_sums"] = FEATURES + f"""
SELECT age < 12 AS under_1_yr, fam_size < 50 AS under_50_fam, count(*) AS n_rows,
  {", ".join(f"round(sum(CAST({c} AS double)), 6) AS sum_{c}" for c in NUMERIC)}
FROM features_p1 GROUP BY 1, 2
"""
Q["cohort_counts"] = FEATURES + f"""
SELECT age < 12 AS under_1_yr, fam_size < 50 AS under_50_fam, count(*) AS n_rows,
  {", ".join(f"count({c}) AS cnt_{c}" for c in NUMERIC)}
FROM features_p1 GROUP BY 1, 2
"""
Q["column_totals"] = FEATURES + f"""
SELECT column_name, total FROM (
  UNPIVOT (SELECT {", ".join(f"round(sum(CAST({c} AS double)), 6) AS {c}" for c in NUMERIC)} FROM features_p1)
  ON COLUMNS(*) INTO NAME column_name VALUE total) u
"""
Q["mean_by_flag"] = FEATURES + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, CAST({f} AS varchar) AS flag_value, round(avg(frac_7726), 6) AS mean_frac_7726, "
    f"round(avg(optout_frac), 6) AS mean_optout_frac FROM features_p1 GROUP BY 1, 2 "
    for f in ["parent", "isv", "cannabis"])

# --- risk-score arithmetic --------------------------------------------------
Q["baseline_rmse"] = FEATURES + """
SELECT 'optout' AS target, count(optout_frac) AS n, round(stddev_pop(optout_frac), 6) AS rmse FROM features_p2
UNION ALL
SELECT 'spam' AS target, count(frac_7726) AS n, round(stddev_pop(frac_7726), 6) AS rmse FROM features_p2
"""
Q["geomean_top"] = FEATURES + """
SELECT account_id, frac_7726, optout_frac, sqrt(frac_7726 * optout_frac) AS score_sqrt
FROM features_p2 ORDER BY score_sqrt DESC, account_id LIMIT 10
"""
Q["geomean_plus_top"] = FEATURES + """
SELECT account_id, frac_7726, optout_frac, sqrt((frac_7726 + 1.0::double) * optout_frac) AS score_sqrt_plus
FROM features_p2 ORDER BY score_sqrt_plus DESC, account_id LIMIT 10
"""
# --- message profiles -------------------------------------------------------
for _c in ["from_cc", "to_cc", "from_type", "status"]:
    Q[f"share_{_c}"] = SNAP_MONTH + f"""
SELECT {_c}, count(*) AS ct_{_c}, count(*) / sum(CAST(count(*) AS double)) OVER () AS perc_{_c}
FROM snap GROUP BY 1 ORDER BY 2 DESC
"""
Q["share_cc_pair"] = SNAP_MONTH + """
SELECT from_cc, to_cc, count(*) AS ct_pair, count(*) / sum(CAST(count(*) AS double)) OVER () AS perc_pair
FROM snap GROUP BY 1, 2 ORDER BY 3 DESC
"""
Q["share_error_code"] = SNAP_MONTH + """
SELECT error_code, count(*) AS ct_error_code,
       count(*) / sum(CAST(count(*) AS double)) OVER () AS perc_error_code
FROM snap WHERE error_code != 0 GROUP BY 1 ORDER BY 2 DESC
"""
Q["top_error_codes"] = """
SELECT error_code, count(*) AS ct FROM messages
WHERE date_updated >= TIMESTAMP '2024-01-01' AND date_updated <= TIMESTAMP '2024-01-30'
GROUP BY 1 ORDER BY ct DESC, error_code LIMIT 25
"""
Q["top_failed_codes"] = """
SELECT error_code, count(*) AS ct FROM messages WHERE status = 'FAILED'
GROUP BY error_code ORDER BY count(*) DESC, error_code LIMIT 20
"""
Q["dq_duplicates"] = TRAITS + """
SELECT customer_id, account_id, count(*) AS n FROM isv_link GROUP BY customer_id, account_id HAVING count(*) > 1
"""
Q["dq_null_keys"] = "SELECT parent_sid, sid FROM accounts WHERE sid IS NULL"
Q["dq_key_containment"] = """
SELECT count(DISTINCT customer_id) AS n_customers FROM customer_link
WHERE customer_id IN (SELECT DISTINCT id FROM isv_list)
"""
Q["dq_weeks_per_account"] = SNAP_MONTH + "," + _mode_cte("from_type") + """
SELECT account_id, count(*) AS n_weeks FROM mode_from_type GROUP BY account_id
"""
Q["dq_week_duplicates"] = WEEK_RATES + "," + MODES_AND_TRAITS + "," + TRAITS + """
SELECT u.account_id, u.wk, count(*) AS n
FROM week_rates u
INNER JOIN traits_v3 r ON u.account_id = r.account_id AND u.wk = r.wk
INNER JOIN traits a ON u.account_id = a.sid
GROUP BY u.account_id, u.wk HAVING count(*) > 1
"""

# --- exact KNN (train = period-1 accounts whose md5 prefix % 10 < 7) ---------
_SPLIT = "CAST('0x' || substr(md5(CAST(account_id AS VARCHAR)), 1, 4) AS INTEGER) % 10"
KNN_FEATURES = ["age", "isv", "parent", "unreachable_frac", "frac_30007", "frac_21610", "frac_30008",
                "aup_frac", "fraud_frac", "cannabis", "fam_size", "default_name"]
_DIST = " + ".join(f"(CAST(q.{c} AS double) - CAST(t.{c} AS double)) * (CAST(q.{c} AS double) - CAST(t.{c} AS double))"
                   for c in KNN_FEATURES)


def _knn_ranked(name: str, query: str, target: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT q.account_id AS qid, q.{target} AS actual, t.{target} AS y,
      row_number() OVER (PARTITION BY q.account_id ORDER BY {_DIST}, t.account_id) AS rn
    FROM {query} q, (SELECT * FROM features_p1 WHERE {_SPLIT} < 7) t) x
  WHERE rn <= {k})"""


Q["knn_predict"] = FEATURES + "," + _knn_ranked("nn", "features_p2", "optout_frac", 23) + """
SELECT qid AS account_id, any_value(actual) AS optout_frac, round(avg(y), 6) AS knn_pred FROM nn GROUP BY qid
"""


def _sweep(target_name: str, target: str) -> str:
    parts = []
    for split, cond in (("train", "< 7"), ("test", ">= 7")):
        parts.append(_knn_ranked(f"nn_{target_name}_{split}",
                                 f"(SELECT * FROM features_p1 WHERE {_SPLIT} {cond})", target, 50))
        parts.append(f"""
rm_{target_name}_{split} AS (
  SELECT rn AS k, round(sqrt(avg((actual - pred) * (actual - pred))), 6) AS rmse,
    round(1.0::double - sum((actual - pred) * (actual - pred))
          / nullif(var_pop(actual) * count(actual), 0), 6) AS r2 FROM (
    SELECT qid, rn, actual,
      avg(y) OVER (PARTITION BY qid ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pred
    FROM nn_{target_name}_{split}) p GROUP BY rn)""")
    return ",".join(parts)


Q["knn_k_sweep"] = FEATURES + "," + _sweep("optout", "optout_frac") + "," + _sweep("spam", "frac_7726") + """
SELECT 'optout' AS target, a.k, a.rmse AS train_rmse, b.rmse AS test_rmse, a.r2 AS train_r2, b.r2 AS test_r2
FROM rm_optout_train a JOIN rm_optout_test b ON a.k = b.k
UNION ALL
SELECT 'spam' AS target, a.k, a.rmse AS train_rmse, b.rmse AS test_rmse, a.r2 AS train_r2, b.r2 AS test_r2
FROM rm_spam_train a JOIN rm_spam_test b ON a.k = b.k
"""

Q["sorted_21610"] = FEATURES + "SELECT account_id, frac_21610 FROM features_p1 ORDER BY frac_21610 NULLS LAST, account_id"

Q["knn_best_k"] = Q["knn_k_sweep"].replace("""
SELECT 'optout' AS target, a.k, a.rmse AS train_rmse, b.rmse AS test_rmse,""", """,
sweep AS (
SELECT 'optout' AS target, a.k, a.rmse AS train_rmse, b.rmse AS test_rmse,""").rstrip() + """)
SELECT target, arg_min(k, (test_rmse, k)) AS k, min(test_rmse) AS test_rmse FROM sweep GROUP BY target
"""

Q["knn_predict_spam"] = FEATURES + "," + _knn_ranked("nn", "features_p2", "frac_7726", 43) + """
SELECT qid AS account_id, any_value(actual) AS frac_7726, round(avg(y), 6) AS knn_pred FROM nn GROUP BY qid
"""

# --- risk scores on the KNN predictions --------------------------------------
PREDICTED = FEATURES + "," + _knn_ranked("near_o", "features_p2", "optout_frac", 23) + "," \
    + _knn_ranked("near_s", "features_p2", "frac_7726", 43) + """,
predicted AS (
  SELECT f.account_id, f.optout_frac, f.frac_7726, o.p AS optout_pred, s.p AS spam_pred
  FROM features_p2 f
  JOIN (SELECT qid, round(avg(y), 6) AS p FROM near_o GROUP BY qid) o ON o.qid = f.account_id
  JOIN (SELECT qid, round(avg(y), 6) AS p FROM near_s GROUP BY qid) s ON s.qid = f.account_id)"""
Q["hist_risk"] = PREDICTED + "," + _hist("predicted", "100.0::double * optout_pred", 10, "0.0", "10.0")
Q["blend_sweep_top20"] = PREDICTED + """,
wts AS (SELECT CAST(i AS double) * 0.1::double AS w FROM range(0, 10) t(i)),
scored AS (
  SELECT round(w, 1) AS weight, account_id, spam_pred, optout_pred, frac_7726, optout_frac,
         w * spam_pred + (1.0::double - w) * optout_pred AS risk_score
  FROM predicted, wts)
SELECT * FROM (
  SELECT weight, row_number() OVER (PARTITION BY weight ORDER BY risk_score DESC, account_id) AS rnk,
         account_id, spam_pred, optout_pred, frac_7726, optout_frac, risk_score FROM scored) x
WHERE rnk <= 20
"""
Q["risk_capped"] = PREDICTED + """
SELECT account_id, optout_pred, optout_frac, 100.0::double * optout_pred AS risk,
       least(100.0::double * optout_pred, 10.0::double) AS risk_capped
FROM predicted
"""
Q["risk_quantile"] = PREDICTED + """,
r AS (SELECT 100.0::double * optout_pred AS risk FROM predicted)
SELECT count(risk) AS n, round(avg(risk), 6) AS mean, round(stddev_samp(risk), 6) AS std, min(risk) AS min,
  round(quantile_cont(risk, 0.25), 6) AS p25, round(quantile_cont(risk, 0.5), 6) AS p50,
  round(quantile_cont(risk, 0.75), 6) AS p75, max(risk) AS max, round(quantile_cont(risk, 0.85), 6) AS p_q,
  count(*) FILTER (WHERE risk > 10.0::double) AS n_above
FROM r
"""
