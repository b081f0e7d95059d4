"""DuckDB forms of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

# Fixed values, written out here once more so that a slip in the plans shows.
WEIGHTS = {
    "structuring": 0.9, "circular": 0.9, "passthrough": 0.8, "fan_in": 0.8, "fan_out": 0.8, "fiat_to_crypto": 0.7, "community": 0.15,
    "round_amounts": 0.25, "dormant_reactivation": 0.3, "activity_spike": 0.3, "device_linkage": 0.6,
}
SCREENING = {"sanctioned": 4.5, "blacklisted": 2.5, "prior_fraud": 1.8, "account_takeover": 1.4}
PROFILE = {
    "high_risk_country": 0.45, "fresh_account": 0.30, "kyc_risk": 0.30, "crypto_channel": 0.25, "pep": 0.40, "watchlist": 0.40,
    "prior_sars": 0.40, "adverse_media": 0.45, "shell_company": 0.50, "geo_mismatch": 0.35, "high_risk_mcc": 0.30, "vpn_tor": 0.30,
    "failed_verifications": 0.25, "activity_vs_profile": 0.45, "chargeback_history": 0.30, "device_integrity": 0.40, "ip_risk": 0.35,
    "automation": 0.35, "auth_anomaly": 0.30, "prior_fraud": 0.50, "account_takeover": 0.40, "blacklisted": 0.50, "unverified": 0.25,
    "historical_risk": 0.35,
}
SHOWN = {
    "Behavioural": (0, ["structuring", "circular", "passthrough", "fan_in", "fan_out", "round_amounts", "dormant_reactivation", "activity_spike", "automation", "auth_anomaly"]),
    "Network": (1, ["network_association", "device_linkage", "community", "geo_mismatch", "ip_risk", "vpn_tor"]),
    "Crypto": (2, ["fiat_to_crypto", "crypto_channel"]),
    "Identity": (3, ["high_risk_country", "fresh_account", "kyc_risk", "unverified", "pep", "high_risk_mcc", "activity_vs_profile", "shell_company", "failed_verifications"]),
    "Screening": (4, ["watchlist", "sanctions_hit"]),
    "Device": (5, ["device_integrity"]),
    "History": (6, ["prior_sars", "adverse_media", "chargeback_history", "prior_fraud", "account_takeover", "blacklisted", "historical_risk"]),
}
EVERY = {
    "pep": 53, "sanctioned": 211, "watchlist": 67, "adverse_media": 71, "nominee_owner": 5, "vpn_tor": 13, "emulator": 37,
    "rooted_jailbroken": 23, "proxy": 47, "prior_fraud": 97, "account_takeover": 101, "blacklisted": 103,
}


def rnd(x: str, digits: int) -> str:
    s = f"{10**digits}e0"
    return f"floor(({x}) * {s} + 0.5e0) / {s}"


def case(column: str, values: dict, other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {other} END"


H = 3_600_000_000
LEGIT = "coalesce(account_type = 'business' AND kyc_risk = 'low', false)"


def relay(name: str, least: int, ratio: str, left: str = "true", right: str = "true") -> str:
    return f"""{name} AS (
  SELECT i.dst AS account_id, i.amount_c AS in_c, o.amount_c AS out_c, i.channel AS in_channel, i.us AS start_us, o.us AS end_us, (o.us - i.us) / {H}e0 AS took
  FROM tx i JOIN tx o ON o.src = i.dst AND o.us BETWEEN i.us AND i.us + {24 * H} AND o.dst <> i.src
  WHERE i.amount_c >= {least} AND {ratio} AND {left} AND {right}
  QUALIFY row_number() OVER (PARTITION BY i.dst ORDER BY i.tx_pos, o.tx_pos) = 1)"""


def relay_score(name: str, first: str) -> str:
    done, speed = "least(1e0, out_c / in_c)", "greatest(0e0, 1e0 - took / 24e0)"
    return f"""{name} AS (SELECT account_id, in_c, out_c, in_channel, {rnd("took", 1)} AS hours, {rnd(done, 2)} AS completeness, {rnd(speed, 2)} AS speed,
  {rnd(f"least(1e0, 0.55e0 + 0.25e0 * {done} + 0.20e0 * {speed})", 2)} AS score, start_us, end_us FROM {first})"""


def spike(name: str, least: int, quiet: int, value: int) -> str:
    burst = "burst_tx / greatest(1, baseline_tx)"
    return f"""{name} AS (SELECT account_id, burst_tx, baseline_tx, burst_value_c,
  {rnd(f"least(1e0, 0.4e0 + 0.05e0 * (burst_tx - {least}) + 0.2e0 * least(1e0, {burst} / 5e0) + 0.2e0 * least(1e0, burst_value_c / 10000000e0))", 2)} AS score, start_us, end_us
  FROM (SELECT account_id, n AS burst_tx, al - n AS baseline_tx, CAST(v AS BIGINT) AS burst_value_c, us AS start_us, e AS end_us FROM spans
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY n DESC, us) = 1)
  WHERE burst_tx >= {least} AND baseline_tx <= {quiet} AND burst_value_c >= {value})"""


def fan(name: str, hub: str, party: str) -> str:
    factor = "least(1e0, CASE WHEN account_type = 'business' THEN 0.35e0 ELSE 1e0 END * CASE kyc_risk WHEN 'low' THEN 0.5e0 WHEN 'high' THEN 1.1e0 ELSE 1e0 END)"
    return f"""{name}_best AS (SELECT a.{hub} AS hub, a.us, count(DISTINCT b.{party}) AS n FROM tx a JOIN tx b ON a.{hub} = b.{hub} AND b.us BETWEEN a.us AND a.us + {48 * H}
  GROUP BY a.{hub}, a.us HAVING count(DISTINCT b.{party}) >= 5 QUALIFY row_number() OVER (PARTITION BY a.{hub} ORDER BY count(DISTINCT b.{party}) DESC, a.us) = 1),
{name} AS (SELECT hub AS account_id, n, {rnd("f", 2)} AS legit_hub_factor, cps AS counterparties, {rnd("least(1e0, 0.4e0 + 0.05e0 * n) * f", 2)} AS score, us AS start_us
  FROM (SELECT h.hub, h.n, h.us, list_sort(list(DISTINCT t.{party})) AS cps, coalesce(any_value({factor}), 1e0) AS f
        FROM {name}_best h JOIN tx t ON t.{hub} = h.hub AND t.us BETWEEN h.us AND h.us + {48 * H} LEFT JOIN acc ON account_id = h.hub GROUP BY ALL))"""


def round_amounts(name: str, step: int) -> str:
    return f"""{name} AS (SELECT account_id, n AS round_tx_count, {rnd("n / al", 2)} AS round_share, ids AS tx_ids, {rnd("least(1e0, 0.3e0 + 0.08e0 * (n - 3) + 0.3e0 * (n / al))", 2)} AS score
  FROM (SELECT account_id, count(*) FILTER (c) AS n, count(*) AS al, (list(tx_id ORDER BY tx_pos) FILTER (c))[1:10] AS ids
        FROM (SELECT *, amount_c % {step} = 0 AND amount_c >= {step} AS c FROM ends) GROUP BY account_id) WHERE n >= 3)"""


def cycles(chain: str, name: str, longest: int, span: int, hops: str = "hops", shortest: int = 3) -> list[str]:
    took = f"(at_us - start_us) / {H}e0"
    return [
        f"""{chain}(start, node, nodes, tx_ids, start_us, at_us, out_c, back_c, start_pos, closed) AS (
  SELECT src, dst, [src, dst], [tx_id], us, us, amount_c, amount_c, tx_pos, false FROM {hops} WHERE bef = -4000000000000000000
  UNION ALL
  SELECT p.start, h.dst, CASE WHEN h.dst = p.start THEN p.nodes ELSE list_append(p.nodes, h.dst) END, list_append(p.tx_ids, h.tx_id), p.start_us, h.us, p.out_c, h.amount_c, p.start_pos, h.dst = p.start
  FROM {chain} p JOIN {hops} h ON h.src = p.node AND h.us > p.at_us AND h.bef <= p.at_us AND h.us <= p.start_us + {span * H}
  WHERE NOT p.closed AND (h.dst = p.start OR (len(p.nodes) < {longest} AND NOT list_contains(p.nodes, h.dst))))""",
        f"""{name} AS (SELECT * FROM (SELECT list_sort(nodes) AS members, nodes, tx_ids, len(nodes) AS length, {rnd("back_c / out_c", 2)} AS retention, {rnd(took, 1)} AS hours,
  {rnd(f"least(1e0, 0.5e0 * (back_c / out_c) + 0.5e0 * (1e0 - least(1e0, ({took}) / {span}e0)))", 2)} AS score, start_us, at_us AS end_us, start_pos
  FROM {chain} WHERE closed AND len(nodes) >= {shortest} AND back_c * 10 >= out_c * 7 AND back_c * 4 <= out_c * 5)
  WHERE NOT list_has_all((SELECT coalesce(list(account_id), []) FROM acc WHERE {LEGIT}), members)
  QUALIFY row_number() OVER (PARTITION BY members ORDER BY score DESC, start_us, start_pos, nodes) = 1)""",
    ]


def community(name: str, least: int) -> str:
    """Moves in rounds as a recursion: a row for each account and turn, with its node, community and the state of the whole."""
    return f"""{name}_pay AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(amount_c) AS HUGEINT) AS w FROM tx WHERE amount_c >= {least} GROUP BY 1, 2),
{name}_both AS (SELECT a, b, w FROM {name}_pay UNION ALL SELECT b, a, w FROM {name}_pay WHERE a <> b),
{name}_degree AS (SELECT a AS account, sum(CASE WHEN a = b THEN 2 * w ELSE w END) AS degree FROM {name}_both GROUP BY a),
{name}_part(turn, grouped, moved, every, last, account, node, community, active) AS (
  SELECT 0, false, false, true, false, account, account, account, true FROM {name}_degree
  UNION ALL
  (WITH homes AS (SELECT node, any_value(community) AS community, bool_or(active) AS active, sum(degree) AS degree FROM {name}_part JOIN {name}_degree USING (account) GROUP BY node),
  sizes AS (SELECT community, sum(degree) AS size FROM homes GROUP BY community),
  links AS (SELECT x.node, y.node AS other, any_value(y.community) AS community, sum(w) AS w FROM {name}_both JOIN {name}_part x ON x.account = a JOIN {name}_part y ON y.account = b WHERE x.node <> y.node GROUP BY x.node, y.node),
  near AS (SELECT node, community, sum(w) AS w FROM (SELECT l.node, l.community, l.w FROM links l JOIN homes h ON h.node = l.node AND h.active UNION ALL SELECT node, community, 0 FROM homes WHERE active) GROUP BY node, community),
  judged AS (SELECT n.node, h.degree, h.community AS now, n.community, n.community = h.community AS own,
      (SELECT 2 * sum(w) FROM {name}_pay) * n.w - h.degree * (s.size - CASE WHEN n.community = h.community THEN h.degree ELSE 0 END) AS value
    FROM near n JOIN homes h USING (node) JOIN sizes s ON s.community = n.community),
  eager AS (SELECT node, degree, now, max(value) FILTER (own) AS stay, min({{'m': -value, 'c': community}}) FILTER (NOT own) AS t
    FROM judged GROUP BY node, degree, now HAVING max(value) FILTER (NOT own) > max(value) FILTER (own)),
  wishes AS (SELECT node, degree, now, -t.m - stay AS gain, t.c AS target, md5(node) AS h FROM eager),
  missed AS (SELECT w.node, sum(l.w * (CASE WHEN w.target = v.now THEN 1 ELSE 0 END + CASE WHEN v.target = w.now THEN 1 ELSE 0 END)) AS lost
    FROM wishes w JOIN links l ON l.node = w.node JOIN wishes v ON v.node = l.other WHERE (w.target = v.now OR v.target = w.now) AND (v.gain > w.gain OR v.gain = w.gain AND v.node < w.node) GROUP BY w.node),
  crowd AS (SELECT w.*, coalesce(lost, 0) * (SELECT 2 * sum(w) FROM {name}_pay) AS lost FROM wishes w LEFT JOIN missed USING (node)),
  gone AS (SELECT node, target, gain - ahead * degree - lost AS margin FROM (SELECT *, coalesce(sum(degree) OVER (PARTITION BY now ORDER BY gain DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + coalesce(sum(degree) OVER (PARTITION BY target ORDER BY gain DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM crowd) WHERE gain > ahead * degree + lost),
  woken AS (SELECT node FROM links WHERE other IN (SELECT node FROM gone) UNION SELECT node FROM eager UNION SELECT node FROM gone),
  seen AS (SELECT count(*) > 0 AS eager, coalesce((SELECT sum(margin) FROM gone), 0) * 1000 >= (SELECT 4 * sum(w) * sum(w) FROM {name}_pay) AS much FROM eager),
  step AS (SELECT CASE WHEN grouped THEN CASE WHEN much THEN 'on' WHEN moved THEN 'groups' ELSE 'accounts' END
      WHEN eager AND (much OR last) THEN 'on' WHEN NOT last THEN 'groups' WHEN NOT every THEN 'again' ELSE 'stop' END AS next FROM seen, (SELECT any_value(grouped) AS grouped, any_value(moved) AS moved, any_value(every) AS every, any_value(last) AS last FROM {name}_part))
  SELECT turn + 1, CASE next WHEN 'groups' THEN true WHEN 'accounts' THEN false ELSE grouped END, next = 'on', next <> 'on', last OR next = 'accounts', account,
    CASE next WHEN 'groups' THEN coalesce(g.target, p.community) WHEN 'accounts' THEN account ELSE p.node END, coalesce(g.target, p.community), next <> 'on' OR w.node IS NOT NULL
  FROM {name}_part p CROSS JOIN step LEFT JOIN gone g ON g.node = p.node LEFT JOIN woken w ON w.node = p.node WHERE next <> 'stop')),
{name}_home AS (SELECT account AS account_id, community FROM {name}_part WHERE turn = (SELECT max(turn) FROM {name}_part)),
{name} AS (SELECT members, size, {rnd("share", 3)} AS density, {rnd("least(1e0, share)", 2)} AS score FROM (
  SELECT members, size, 2 * m / (size * (size - 1)) AS share FROM (SELECT community, list_sort(list(account_id)) AS members, count(*) AS size FROM {name}_home GROUP BY 1)
  JOIN (SELECT x.community, count(*) AS m FROM {name}_pay JOIN {name}_home x ON a = x.account_id JOIN {name}_home y ON b = y.account_id AND x.community = y.community WHERE a <> b GROUP BY 1) USING (community)
  WHERE size BETWEEN 3 AND 12) WHERE share >= 0.5e0)"""


SCREEN = " UNION ALL ".join(f"SELECT account_id, '{'sanctions_hit' if c == 'sanctioned' else c}' AS detector, {v}e0 AS points FROM acc WHERE {c}" for c, v in SCREENING.items())


def capped(n: str, least: int, most: int) -> str:
    return f"CASE WHEN {n} >= {least} THEN {rnd(f'least(1e0, {n} / {most}e0)', 2)} END"


def over_half(n: str) -> str:
    return f"CASE WHEN {n} >= 0.5e0 THEN {rnd(n, 2)} END"


def yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1e0 END"


SIGNALS = {
    "high_risk_country": yes("country IN ('RU', 'AE')"),
    "fresh_account": "fresh",
    "kyc_risk": "CASE kyc_risk WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.5e0 END",
    "crypto_channel": f"CASE WHEN all_c > 0 AND risky_c / all_c >= 0.5e0 AND risky_c >= 1000000 THEN {rnd('risky_c / all_c', 2)} END",
    "prior_sars": capped("prior_sars", 1, 3),
    "shell_company": yes("account_type = 'business' AND nominee_owner AND fresh > 0 AND country IN ('RU', 'AE')"),
    "geo_mismatch": f"CASE WHEN away >= 0.3e0 THEN {rnd('away', 2)} END",
    "high_risk_mcc": yes("business_category IN ('crypto_exchange', 'money_services', 'gambling', 'precious_metals')"),
    "failed_verifications": capped("failed_verifications", 2, 5),
    "chargeback_history": capped("chargeback_count", 1, 4),
    "device_integrity": "CASE WHEN emulator THEN 1e0 WHEN rooted_jailbroken THEN 0.6e0 END",
    "ip_risk": f"CASE WHEN ip_risk_score >= 0.5e0 OR proxy THEN {rnd('greatest(ip_risk_score, CASE WHEN proxy THEN 0.6e0 ELSE 0e0 END)', 2)} END",
    "automation": over_half("automation_score"),
    "auth_anomaly": capped("failed_logins_30d", 3, 10),
    "unverified": yes("verification_level = 'unverified'"),
    "historical_risk": over_half("historical_risk_score"),
    "activity_vs_profile": f"CASE WHEN expected_monthly_volume > 0 AND all_c >= 1000000 AND all_c / 100e0 / expected_monthly_volume >= 4 THEN {rnd('least(1e0, all_c / 100e0 / expected_monthly_volume / 20e0)', 2)} END",
} | {n: yes(n) for n in ("pep", "watchlist", "adverse_media", "vpn_tor", "prior_fraud", "account_takeover", "blacklisted")}

FLAGS = ("pep", "sanctioned", "watchlist", "adverse_media", "nominee_owner", "prior_fraud", "account_takeover", "blacklisted", "emulator", "rooted_jailbroken", "proxy", "vpn_tor")
COUNTS = {"prior_sars": 0, "chargeback_count": 0, "disputes_count": 0, "failed_logins_30d": 0, "device_count": 1, "distinct_ips": 1, "linked_accounts": 0}
ELEVATED = " UNION ALL ".join(
    [f"SELECT account_id, '{f}' AS attribute, 'true' AS value FROM acc WHERE {f}" for f in FLAGS]
    + ["SELECT account_id, 'unverified', 'true' FROM acc WHERE verification_level = 'unverified'"]
    + [f"SELECT account_id, '{n}', CAST({n} AS VARCHAR) FROM acc WHERE {n} > {m}" for n, m in COUNTS.items()]
    + [f"SELECT account_id, '{x}', printf('%.2f', {rnd(x, 2)}) FROM acc WHERE {x} >= 0.5e0" for x in ("ip_risk_score", "automation_score", "historical_risk_score", "night_activity_ratio")]
    + ["SELECT account_id, 'ip_country_mismatch', ip_country || ' vs home ' || country FROM acc WHERE ip_country <> country"]
)

CTES = [
    "u AS (SELECT max(user_id) + 1 AS n FROM events)",
    """tx AS (SELECT 'T' || event_id AS tx_id, epoch_us(ts) AS us, 'A' || (user_id * 10 + event_id % 10) AS src,
  'A' || (CASE WHEN k < 10 THEN k * 7 ELSE (user_id * 7 + k * 13 + event_id % 10) % (n * 10) END) AS dst, CAST(floor(value * 20000) AS BIGINT) AS amount_c,
  CASE event_type WHEN 'click' THEN 'card' WHEN 'view' THEN 'sepa' WHEN 'purchase' THEN 'wire' WHEN 'signup' THEN 'crypto' ELSE 'cash_deposit' END AS channel,
  CASE event_id % 3 WHEN 0 THEN 'RU' WHEN 2 THEN 'GR' END AS tx_country, event_id AS tx_pos
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events), u)""",
    f"""acc AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'RU' ELSE country END AS ip_country FROM (SELECT 'A' || k AS account_id, c_name AS owner_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'business' ELSE 'personal' END AS account_type,
  CASE WHEN k % 17 = 0 THEN 'RU' WHEN k % 19 = 0 THEN 'AE' ELSE ['GR', 'CY', 'DE', 'FR'][c_nationkey % 4 + 1] END AS country,
  strftime(DATE '2018-01-01' + CAST(k * 37 % 2190 AS INTEGER), '%Y-%m-%d') AS opened_at,
  CASE WHEN c_acctbal < 1500 THEN 'high' WHEN c_acctbal < 4000 THEN 'medium' ELSE 'low' END AS kyc_risk, 'active' AS status,
  CASE WHEN k % 29 = 0 THEN k % 4 ELSE 0 END AS prior_sars, CASE WHEN k % 41 = 0 THEN 'gambling' WHEN k % 43 = 0 THEN 'crypto_exchange' ELSE 'retail' END AS business_category,
  CASE WHEN k % 7 <> 0 THEN (k % 50) * 1000e0 END AS expected_monthly_volume, CASE WHEN k % 20 < 4 THEN 'D' || (k // 20) END AS device_id,
  CASE WHEN k % 15 < 3 THEN 'I' || (k // 30) END AS signup_ip, CASE WHEN k % 50 < 3 THEN 'E' || (k // 50) END AS email, CASE WHEN k % 3 = 0 THEN '' ELSE 'P' || k END AS phone,
  k % 6 AS failed_verifications, CASE WHEN k % 31 = 0 THEN k % 5 ELSE 0 END AS chargeback_count, CASE WHEN k % 11 = 0 THEN 'unverified' ELSE 'basic' END AS verification_level,
  (k % 100) / 100e0 AS ip_risk_score, k % 8 AS failed_logins_30d, (k % 60) / 100e0 AS automation_score, (k % 80) / 100e0 AS historical_risk_score, (k % 90) / 100e0 AS night_activity_ratio,
  1 + k % 3 AS device_count, 1 + k % 4 AS distinct_ips, k % 3 AS disputes_count, k % 2 AS linked_accounts, k,
  {", ".join(f"k % {n} = 0 AS {c}" for c, n in EVERY.items())}
  FROM (SELECT *, c_custkey AS k FROM customer)))""",
    "ends AS (SELECT src AS account_id, us, amount_c, tx_pos, tx_id, channel FROM tx UNION ALL SELECT dst, us, amount_c, tx_pos, tx_id, channel FROM tx)",
    "pairs AS (SELECT src, dst, CAST(sum(amount_c) AS BIGINT) AS total_c, max(amount_c) AS max_c, count(*) AS n FROM tx GROUP BY src, dst)",
    f"ages AS (SELECT account_id, CAST(floor(((SELECT max(us) FROM tx) - epoch_us(CAST(opened_at AS TIMESTAMP))) / {24 * H}e0) AS BIGINT) AS age FROM acc)",
    f"""structuring AS (SELECT dst AS account_id, n, CAST(total_c AS BIGINT) AS total_c, {rnd("cl", 2)} AS closeness, {rnd("sp", 1)} AS span_hours,
  {rnd("least(1e0, 0.6e0 + 0.1e0 * (n - 3) + 0.18e0 * cl + 0.12e0 * (1e0 - least(1e0, sp / 72e0)))", 2)} AS score, us AS start_us, end_us
  FROM (SELECT *, greatest(0e0, least(1e0, (total_c / n / 1000000e0 - 0.7e0) / 0.3e0)) AS cl, (end_us - us) / {H}e0 AS sp
        FROM (SELECT dst, us, tx_pos, count(*) OVER w AS n, sum(amount_c) OVER w AS total_c, max(us) OVER w AS end_us FROM tx WHERE amount_c >= 700000 AND amount_c < 1000000
              WINDOW w AS (PARTITION BY dst ORDER BY us RANGE BETWEEN CURRENT ROW AND {72 * H} FOLLOWING))
        WHERE n >= 3 AND total_c >= 1000000 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY us, tx_pos) = 1))""",
    relay("pass_first", 500_000, "o.amount_c * 10 >= i.amount_c * 8"),
    relay_score("passthrough", "pass_first"),
    relay("crypto_first", 500_000, "o.amount_c * 2 >= i.amount_c", "i.channel IN ('sepa', 'wire', 'card', 'cash_deposit')", "o.channel = 'crypto'"),
    relay_score("fiat_to_crypto", "crypto_first"),
    relay("dormant_first", 1_000_000, "o.amount_c * 10 >= i.amount_c * 8"),
    f"""dormant_reactivation AS (SELECT account_id, age AS account_age_days, in_c, out_c, {rnd("took", 1)} AS hours,
  {rnd("least(1e0, 0.55e0 + 0.25e0 * greatest(0e0, 1e0 - took / 24e0) + 0.2e0 * least(1e0, age / 1095e0))", 2)} AS score, start_us, end_us
  FROM dormant_first JOIN ages USING (account_id) WHERE age >= 365)""",
    round_amounts("round_amounts", 100_000),
    round_amounts("round_relaxed", 1_000),
    f"""spans AS (SELECT account_id, us, count(*) OVER w AS n, sum(amount_c) OVER w AS v, max(us) OVER w AS e, count(*) OVER (PARTITION BY account_id) AS al FROM ends
  WINDOW w AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {24 * H} FOLLOWING))""",
    spike("activity_spike", 5, 5, 2_000_000),
    spike("spike_relaxed", 3, 12, 0),
    """ident AS (SELECT account_id, key, value FROM (SELECT account_id, unnest(['device_id', 'signup_ip', 'email', 'phone']) AS key, unnest([device_id, signup_ip, email, phone]) AS value FROM acc)
  WHERE value <> '' QUALIFY count(*) OVER (PARTITION BY key, value) >= 3)""",
    f"""device_linkage AS (SELECT account_id, n AS cluster_size, shared, list_filter(linked, lambda x: x <> account_id)[1:10] AS linked_accounts, {rnd("least(1e0, 0.4e0 + 0.1e0 * n)", 2)} AS score
  FROM (SELECT a.account_id, count(DISTINCT b.account_id) AS n, list_sort(list(DISTINCT a.key || '=' || a.value)) AS shared, list_sort(list(DISTINCT b.account_id)) AS linked
        FROM ident a JOIN ident b USING (key, value) GROUP BY a.account_id))""",
    fan("fan_in", "dst", "src"),
    fan("fan_out", "src", "dst"),
    "hops AS (SELECT * FROM (SELECT t.*, coalesce(lag(us) OVER (PARTITION BY src, dst ORDER BY us, tx_pos), -4000000000000000000) AS bef FROM tx t SEMI JOIN (SELECT * FROM pairs WHERE max_c >= 100000 AND src <> dst) p USING (src, dst)) WHERE bef < us)",
    "hops_long AS (SELECT * FROM (SELECT t.*, coalesce(lag(us) OVER (PARTITION BY src, dst ORDER BY us, tx_pos), -4000000000000000000) AS bef FROM tx t SEMI JOIN (SELECT * FROM pairs WHERE max_c >= 150000 AND src <> dst) p USING (src, dst)) WHERE bef < us)",
    *cycles("chain", "circular", 5, 72),
    *cycles("chain_relaxed", "circular_relaxed", 3, 720),
    *cycles("chain_long", "circular_long", 5, 480, "hops_long", 4),
    community("community", 0),
    community("community_large", 3_000_000),
    "findings AS (SELECT 'circular' AS detector, 'subgraph' AS kind, members AS ids, score, CAST(NULL AS VARCHAR[]) AS cps, start_us, end_us FROM circular"
    + "".join(f" UNION ALL SELECT '{d}', 'account', [account_id], score, NULL, start_us, end_us FROM {d}" for d in ("structuring", "passthrough", "fiat_to_crypto", "dormant_reactivation", "activity_spike"))
    + "".join(f" UNION ALL SELECT '{d}', 'account', [account_id], score, NULL, NULL, NULL FROM {d}" for d in ("round_amounts", "device_linkage"))
    + "".join(f" UNION ALL SELECT '{d}', 'account', [account_id], score, counterparties, start_us, NULL FROM {d}" for d in ("fan_in", "fan_out"))
    + ")",
    f"factors AS (SELECT account_id, CASE WHEN {LEGIT} THEN 0.18e0 ELSE 1e0 END AS factor FROM acc)",
    f"""behaviour AS (SELECT account_id, points, least(1e0, points / 0.9e0) AS base FROM (SELECT s.account_id, p / 10000e0 * coalesce(factor, 1e0) AS points
  FROM (SELECT account_id, sum(CAST(round({case("detector", {k: f"{v}e0" for k, v in WEIGHTS.items()}, "0.5e0")} * score * 10000) AS BIGINT)) AS p FROM (SELECT unnest(ids) AS account_id, detector, score FROM findings) GROUP BY account_id) s
  LEFT JOIN factors USING (account_id)))""",
    f"screening AS ({SCREEN})",
    f"""association AS (SELECT a AS account_id, {rnd("hot / al * (risk / 1e9 / n) * coalesce(factor, 1e0)", 3)} AS association
  FROM (SELECT a, sum(w) AS al, sum(w) FILTER (base >= 0.5e0) AS hot, count(*) FILTER (base >= 0.5e0) AS n, sum(CAST(round(base * 1e9) AS BIGINT)) FILTER (base >= 0.5e0) AS risk
        FROM (SELECT a, b, sum(c) AS w FROM (SELECT src AS a, dst AS b, total_c AS c FROM pairs UNION ALL SELECT dst, src, total_c FROM pairs) GROUP BY a, b) LEFT JOIN behaviour ON b = account_id GROUP BY a)
  LEFT JOIN factors ON a = factors.account_id WHERE al > 0 AND n > 0)""",
    """wide AS (SELECT acc.*, all_c, risky_c, away, CASE WHEN age < 90 THEN """
    + rnd("greatest(0e0, (90 - age) / 90e0)", 2)
    + """ END AS fresh FROM acc JOIN ages USING (account_id)
  LEFT JOIN (SELECT account_id, sum(amount_c) AS all_c, coalesce(sum(amount_c) FILTER (channel IN ('crypto', 'cash_deposit')), 0) AS risky_c FROM ends GROUP BY account_id) USING (account_id)
  LEFT JOIN (SELECT src AS account_id, sum(amount_c) FILTER (tx_country <> country) / sum(amount_c) AS away FROM tx LEFT JOIN acc ON src = account_id GROUP BY src HAVING sum(amount_c) > 0) USING (account_id))""",
    "signals AS (" + " UNION ALL ".join(f"SELECT account_id, '{n}' AS component, {v} AS value FROM wide WHERE ({v}) > 0" for n, v in SIGNALS.items()) + ")",
    f"""profile AS (SELECT account_id, least(1e0, p / 10000e0) * coalesce(factor, 1e0) AS profile
  FROM (SELECT account_id, sum(CAST(round({case("component", {k: f"{v}e0" for k, v in PROFILE.items()}, "0e0")} * value * 10000) AS BIGINT)) AS p FROM signals GROUP BY account_id) LEFT JOIN factors USING (account_id))""",
    f"""risk AS (SELECT account_id, {rnd("least(1e0, CASE WHEN bp >= 0.45e0 THEN 0.5e0 + 0.5e0 * (1e0 - exp(-(bp + soft - 0.45e0) / 1.8e0)) ELSE 0.49e0 * (1e0 - exp(-(bp + soft) / 0.8e0)) END)", 3)} AS risk
  FROM (SELECT account_id, coalesce(points, 0e0) + coalesce(screened, 0e0) AS bp, 0.5e0 * coalesce(association, 0e0) + 0.5e0 * coalesce(profile, 0e0) AS soft
        FROM behaviour FULL JOIN (SELECT account_id, sum(points) AS screened FROM screening GROUP BY account_id) USING (account_id)
        FULL JOIN association USING (account_id) FULL JOIN profile USING (account_id)))""",
    f"""shown AS (SELECT account_id, detector, max(score) AS score FROM (SELECT unnest(ids) AS account_id, detector, {rnd("score", 2)} AS score FROM findings UNION ALL SELECT account_id, detector, 1e0 FROM screening
  UNION ALL SELECT account_id, component, value FROM signals UNION ALL SELECT account_id, 'network_association', {rnd("association", 2)} FROM association WHERE association > 0) GROUP BY account_id, detector
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY max(score) DESC, detector) <= 12)""",
    "big AS (SELECT src, dst FROM pairs WHERE total_c >= 500000)",
    """grown AS (SELECT DISTINCT detector, score, list_sort(list_distinct(list_concat(ids, CASE WHEN kind = 'subgraph' THEN [] WHEN len(cps) > 0 THEN cps ELSE coalesce(near, []) END))) AS members
  FROM findings LEFT JOIN (SELECT a, list(DISTINCT b) AS near FROM (SELECT src AS a, dst AS b FROM big UNION ALL SELECT dst, src FROM big) GROUP BY a) ON a = ids[1]
  WHERE detector IN ('structuring', 'circular', 'passthrough', 'fan_in', 'fan_out') AND (kind = 'subgraph' OR score >= 0.3e0))""",
    "seeds AS (SELECT *, row_number() OVER (ORDER BY score DESC, members, detector) AS place FROM grown g WHERE len(members) >= 2 AND EXISTS (SELECT 1 FROM big WHERE list_contains(g.members, src) AND list_contains(g.members, dst)))",
    """fold(i, c) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(a VARCHAR[], p VARCHAR[])[])
  UNION ALL
  SELECT place, CASE WHEN coalesce(h, 0) = 0 THEN list_append(c, {'a': members, 'p': [detector]}) ELSE list_transform(c, lambda x, j: CASE WHEN j = h
    THEN {'a': list_sort(list_distinct(list_concat(x.a, members))), 'p': list_sort(list_distinct(list_append(x.p, detector)))} ELSE x END) END
  FROM (SELECT s.place, s.members, s.detector, f.c, list_position(list_transform(f.c, lambda x: len(list_intersect(x.a, s.members)) >= 2), true) AS h FROM fold f JOIN seeds s ON s.place = f.i + 1))""",
    "clusters AS (SELECT x.a AS members, x.p AS patterns FROM (SELECT unnest(c) AS x FROM fold WHERE i = (SELECT max(i) FROM fold)))",
]


def measured(name: str, source: str) -> str:
    score = "0.5e0 * (0.6e0 * max_risk + 0.4e0 * avg_risk) + 0.2e0 * least(1e0, 0.25e0 * len(patterns)) + 0.3e0 * least(1e0, volume_c / 5000000e0) + 0.12e0 * greatest(0, len(patterns) - 2)"
    return f"""{name} AS (SELECT members, patterns, volume_c, max_risk, avg_risk, {rnd(f"least(1e0, {score})", 3)} AS score
  FROM (SELECT members, patterns, CAST(coalesce((SELECT sum(total_c) FROM pairs WHERE list_contains(s.members, src) AND list_contains(s.members, dst)), 0) AS BIGINT) AS volume_c, max_risk, avg_risk
        FROM (SELECT members, patterns, max(mille) / 1000e0 AS max_risk, sum(mille) / count(*) / 1000e0 AS avg_risk FROM (SELECT members, patterns, CAST(round(coalesce(risk, 0e0) * 1000) AS BIGINT) AS mille
              FROM (SELECT DISTINCT members, patterns, unnest(members) AS m FROM {source}) LEFT JOIN risk ON m = account_id) GROUP BY members, patterns) s))"""


CTES += [
    measured("seed_measures", "(SELECT DISTINCT members, [detector] AS patterns FROM seeds)"),
    measured("ring_measures", "clusters"),
    """rings AS (SELECT printf('DET_%03d', place) AS ring_id, * FROM (SELECT row_number() OVER (ORDER BY score DESC, members, patterns) AS place, * FROM ring_measures
  WHERE len(members) >= 3 AND max_risk >= 0.5e0 AND score >= 0.45e0 AND volume_c >= 1500000))""",
    "member AS (SELECT ring_id, place, unnest(members) AS account_id FROM rings)",
    "ring_tx AS (SELECT ring_id, place, tx.* FROM rings JOIN tx ON list_contains(members, src) AND list_contains(members, dst))",
    "ring_one AS (SELECT account_id, arg_min(ring_id, place) AS ring FROM member GROUP BY account_id)",
    "tx_ring AS (SELECT tx_id, arg_min(ring_id, place) AS ring FROM ring_tx GROUP BY tx_id)",
    "scored AS (SELECT acc.*, coalesce(risk, 0e0) AS risk FROM acc LEFT JOIN risk USING (account_id))",
    "hits AS (SELECT unnest(ids) AS account_id, detector, score FROM findings)",
    """edges AS (SELECT tx.tx_id, src, dst, amount_c, coalesce(a.risk, 0e0) >= 0.5e0 OR coalesce(b.risk, 0e0) >= 0.5e0 AS suspicious, ring, channel, us, tx_pos
  FROM tx LEFT JOIN risk a ON src = a.account_id LEFT JOIN risk b ON dst = b.account_id LEFT JOIN tx_ring USING (tx_id))""",
    "own AS (SELECT * FROM tx WHERE src = 'A7' OR dst = 'A7')",
    "near1 AS (SELECT DISTINCT n FROM (SELECT src AS n FROM own UNION ALL SELECT dst FROM own) WHERE n <> 'A7')",
    "state AS (SELECT account_id, CASE WHEN risk >= 0.9e0 THEN 'frozen' ELSE 'active' END AS status FROM scored)",
    "sides AS (SELECT dst AS account_id, src AS party, amount_c AS i, 0 AS o, us, true AS inn FROM tx UNION ALL SELECT src, dst, 0, amount_c, us, false FROM tx WHERE src <> dst)",
    """near_hits AS (SELECT account_id, string_agg(detector || ':' || printf('%.2f', score), ' ' ORDER BY score DESC, detector, ids) AS findings FROM (SELECT * FROM (SELECT unnest(ids) AS account_id, * FROM findings)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, detector, ids) <= 10) GROUP BY account_id)""",
    f"marks AS (SELECT account_id, attribute || '=' || value AS flag FROM ({ELEVATED}))",
    "bfs(node, depth) AS (SELECT 'A7', 0 UNION SELECT t.dst, b.depth + 1 FROM bfs b JOIN pairs t ON t.src = b.node WHERE b.depth < 6)",
    "level AS (SELECT node, min(depth) AS d FROM bfs GROUP BY node)",
    """parent AS (SELECT l.node, l.d, t.src, t.tx_id, t.amount_c, t.us, t.channel FROM level l JOIN tx t ON t.dst = l.node JOIN level p ON p.node = t.src AND p.d = l.d - 1
  QUALIFY row_number() OVER (PARTITION BY l.node ORDER BY t.tx_pos) = 1)""",
    "path AS (SELECT * FROM parent WHERE node = 'A900' UNION ALL SELECT p.* FROM path b JOIN parent p ON p.node = b.src)",
]


COMMUNITY = " UNION ALL SELECT 'community', 'subgraph', members, score, NULL, NULL, NULL FROM community_large)"


def sql(final: str, full: bool = False) -> str:
    """full: with communities among the findings."""
    ctes = [c[:-1] + COMMUNITY if full and c.startswith("findings AS") else c for c in CTES]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


def joined(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in columns)


def ego(edges: int, nodes: int) -> str:
    """Two steps around the focus: the largest transfers, among the riskiest nodes and the focus."""
    near = f"(SELECT * FROM edges WHERE src = 'A7' OR dst = 'A7' OR src IN (FROM near1) OR dst IN (FROM near1) ORDER BY amount_c DESC, edges.tx_pos LIMIT {edges})"
    ranked = f"(SELECT n, row_number() OVER (ORDER BY coalesce(risk, 0e0) DESC, n) AS place FROM (SELECT src AS n FROM {near} UNION SELECT dst FROM {near}) LEFT JOIN risk ON n = account_id)"
    return f"SELECT e.* EXCLUDE (tx_pos) FROM {near} e, (SELECT list(n) AS keep FROM {ranked} WHERE place <= {nodes} OR n = 'A7') WHERE list_contains(keep, src) AND list_contains(keep, dst)"


CATEGORY = case("detector", {n: f"'{c}'" for c, (_, names) in SHOWN.items() for n in names}, "'Other'")
PLACE = case("category", {c: i for c, (i, _) in SHOWN.items()}, "7")
NOTE = f"""concat_ws(' ', coalesce(owner_name, 'Unknown owner') || ', account ' || account_id || ': ' || verdict || ' at risk ' || CAST(floor(risk * 100 + 0.5e0) AS BIGINT) || ' of 100.',
  'In ' || CAST(floor(coalesce(i, 0) / 100) AS BIGINT) || ' EUR from ' || coalesce(senders, 0) || ', out ' || CAST(floor(coalesce(o, 0) / 100) AS BIGINT) || ' EUR to ' || coalesce(recipients, 0) || '.',
  'Signals: ' || signals || '.', 'Profile: ' || flags || '.', CASE verdict WHEN 'mule' THEN 'Put before a reviewer.' WHEN 'watch' THEN 'Look again after the next analysis.' ELSE 'Nothing to do.' END)"""
MULES = "SELECT account_id FROM acc WHERE k % 7 = 0"
TRUE = "(SELECT 'T' || (k // 14) AS ring_id, list(DISTINCT account_id) AS ids FROM acc WHERE k % 7 = 0 GROUP BY k // 14)"

FINALS = {
    "structuring": "SELECT * FROM structuring",
    "circular": f"SELECT {joined('members', 'nodes', 'tx_ids')}, length, retention, hours, score, start_us, end_us FROM circular",
    "circular_relaxed": f"SELECT {joined('members', 'nodes', 'tx_ids')}, length, retention, hours, score, start_us, end_us FROM circular_relaxed",
    "passthrough": "SELECT * FROM passthrough",
    "fiat_to_crypto": "SELECT * FROM fiat_to_crypto",
    "round_amounts": f"SELECT * EXCLUDE (tx_ids), {joined('tx_ids')} FROM round_amounts",
    "round_amounts_relaxed": f"SELECT * EXCLUDE (tx_ids), {joined('tx_ids')} FROM round_relaxed",
    "dormant_reactivation": "SELECT * FROM dormant_reactivation",
    "activity_spike": "SELECT * FROM activity_spike",
    "activity_spike_relaxed": "SELECT * FROM spike_relaxed",
    "device_linkage": f"SELECT account_id, cluster_size, {joined('shared', 'linked_accounts')}, score FROM device_linkage",
    "fan_in": f"SELECT * EXCLUDE (counterparties), {joined('counterparties')} FROM fan_in",
    "fan_out": f"SELECT * EXCLUDE (counterparties), {joined('counterparties')} FROM fan_out",
    "pair_sums": "SELECT * FROM pairs",
    "money_edges": "SELECT src, dst FROM pairs WHERE max_c >= 100000",
    "findings": "SELECT detector, kind AS subject_type, array_to_string(ids, ',') AS subject_ids, score, coalesce(start_us, 0) AS start_us, coalesce(end_us, 0) AS end_us, array_to_string(cps, ',') AS counterparties FROM findings",
    "behaviour_points": "SELECT * FROM behaviour",
    "screening_points": "SELECT * FROM screening",
    "network_association": "SELECT * FROM association",
    "profile_signals": "SELECT * FROM signals",
    "profile_raw": "SELECT * FROM profile",
    "account_risk": "SELECT risk.account_id, risk, coalesce(string_agg(detector || ':' || printf('%.2f', score), ' ' ORDER BY score DESC, detector), '') AS top_signals FROM risk LEFT JOIN shown USING (account_id) GROUP BY ALL",
    "ring_seeds": f"SELECT detector, score, {joined('members')} FROM seeds",
    "seed_measures": f"SELECT {joined('members', 'patterns')}, volume_c, max_risk, avg_risk, score FROM seed_measures",
    "rings": f"""SELECT ring_id, {joined("members")}, {joined("patterns")}, score, (SELECT string_agg(account_id, ',' ORDER BY r DESC, account_id) FROM (SELECT m.account_id, coalesce(risk, 0e0) AS r FROM member m LEFT JOIN risk USING (account_id)
  WHERE m.ring_id = rings.ring_id ORDER BY r DESC, m.account_id LIMIT 3)) AS key_accounts, (SELECT string_agg(tx_id, ',' ORDER BY src, dst, tx_pos) FROM ring_tx t WHERE t.ring_id = rings.ring_id) AS tx_ids, (SELECT count(*) FROM ring_tx t WHERE t.ring_id = rings.ring_id) AS n_tx FROM rings""",
    "summary": "SELECT (SELECT count(*) FROM acc) AS accounts, (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM rings) AS rings_detected, (SELECT count(*) FROM risk WHERE risk >= 0.5e0) AS flagged_accounts",
    "accounts_list": f"""SELECT account_id, owner_name, account_type, country, kyc_risk, status, {rnd("risk", 3)} AS risk, coalesce((SELECT string_agg(ring_id, ',' ORDER BY place) FROM member m WHERE m.account_id = scored.account_id), '') AS rings,
  coalesce(n, 0) AS n_findings FROM scored LEFT JOIN (SELECT account_id, count(*) AS n FROM hits GROUP BY account_id) USING (account_id)""",
    "ego_graph_1": "SELECT * EXCLUDE (tx_pos) FROM edges WHERE src = 'A7' OR dst = 'A7'",
    "ego_graph_2": ego(1500, 400),
    "ego_graph_2_capped": ego(60, 20),
    "ego_nodes": "SELECT account_id, risk, account_type, ring, owner_name, country, kyc_risk FROM scored LEFT JOIN ring_one USING (account_id) WHERE account_id = 'A7' OR account_id IN (FROM near1)",
    "suspicious_edges": "SELECT * EXCLUDE (tx_pos) FROM edges WHERE (src = 'A7' OR dst = 'A7') AND (suspicious OR ring IS NOT NULL)",
    "enriched_edges": "SELECT * EXCLUDE (tx_pos) FROM edges",
    "rings_list": f"SELECT ring_id, score, {joined('patterns')}, len(members) AS n_accounts FROM rings",
    "ring_accounts": "SELECT m.account_id, owner_name, coalesce(risk, 0e0) AS risk FROM member m LEFT JOIN scored USING (account_id) WHERE ring_id = 'DET_001'",
    "ring_transactions": "SELECT tx_id, src, dst, amount_c FROM ring_tx WHERE ring_id = 'DET_001' ORDER BY tx_pos LIMIT 200",
    "account_transactions": "SELECT tx_id, src, dst, amount_c, us FROM own ORDER BY tx_pos LIMIT 200",
    "transaction_detail": f"""SELECT e.tx_id, e.src, e.dst, e.amount_c, e.ring, e.channel, e.us, coalesce({rnd("a.risk", 3)}, 0e0) AS src_risk, sa.status AS src_status, a.owner_name AS src_owner, coalesce({rnd("b.risk", 3)}, 0e0) AS dst_risk, sb.status AS dst_status, b.owner_name AS dst_owner
  FROM edges e LEFT JOIN scored a ON e.src = a.account_id LEFT JOIN state sa ON e.src = sa.account_id LEFT JOIN scored b ON e.dst = b.account_id LEFT JOIN state sb ON e.dst = sb.account_id WHERE e.tx_id = 'T7'""",
    "auto_freeze": "SELECT * FROM state",
    "decided_status": "SELECT account_id, CASE WHEN k % 10 = 3 THEN 'active' WHEN k % 10 = 4 THEN 'blocked' ELSE state.status END AS status, k % 10 NOT IN (3, 4) AS auto FROM state JOIN acc USING (account_id)",
    "decision_log": "SELECT account_id, CASE k % 10 WHEN 3 THEN 'active' WHEN 4 THEN 'blocked' WHEN 5 THEN 'frozen' ELSE state.status END AS status, k % 10 NOT IN (3, 4, 5) AS auto FROM state JOIN acc USING (account_id)",
    "risk_order": "SELECT account_id, risk, row_number() OVER (ORDER BY risk DESC, account_id) AS place FROM risk",
    "table_order": f"""SELECT 'rings' AS by, account_id, row_number() OVER (ORDER BY n DESC, {rnd("risk", 3)} DESC, account_id) AS place FROM scored JOIN (SELECT account_id, count(*) AS n FROM member GROUP BY 1) USING (account_id)
  UNION ALL SELECT 'owner', account_id, row_number() OVER (ORDER BY owner_name DESC, account_id) FROM scored JOIN state USING (account_id) WHERE state.status <> 'active'""",
    "review_queue": f"""SELECT account_id, owner_name, account_type, kyc_risk, state.status, {rnd("risk", 3)} AS risk, coalesce((SELECT string_agg(DISTINCT detector, ',' ORDER BY detector) FROM hits h WHERE h.account_id = scored.account_id), '') AS patterns,
  least(10, (SELECT count(*) FROM hits h WHERE h.account_id = scored.account_id)) AS n_findings,
  printf('Risk %d%% ≥ freeze threshold 90%%', CAST(round(risk * 100) AS INTEGER)) AS summary, coalesce(findings, '') AS findings FROM scored JOIN state USING (account_id) LEFT JOIN near_hits USING (account_id) WHERE state.status <> 'active'""",
    "under_review": "SELECT count(*) FILTER (status <> 'active') AS under_review, 0.9e0 AS threshold FROM state",
    "evaluate": f"""SELECT tp, fp, fn, m AS rings_matched, rt AS rings_true, rd AS rings_detected, rd - nr AS false_positive_rings, {rnd("p", 3)} AS precision, {rnd("r", 3)} AS recall, {rnd("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END", 3)} AS f1,
  {rnd("m / rt", 3)} AS ring_recall, {rnd("CASE WHEN rd > 0 THEN (rd - nr) / rd ELSE 0e0 END", 3)} AS false_positive_rate
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r FROM (SELECT
    (SELECT count(*) FROM risk WHERE risk >= 0.5e0 AND account_id IN ({MULES})) AS tp, (SELECT count(*) FROM risk WHERE risk >= 0.5e0 AND account_id NOT IN ({MULES})) AS fp,
    (SELECT count(*) FROM ({MULES}) WHERE account_id NOT IN (SELECT account_id FROM risk WHERE risk >= 0.5e0)) AS fn, (SELECT count(*) FROM rings) AS rd, (SELECT count(*) FROM {TRUE}) AS rt,
    (SELECT count(*) FROM {TRUE} t WHERE EXISTS (SELECT 1 FROM rings WHERE len(list_intersect(members, ids)) / len(ids) >= 0.6e0)) AS m,
    (SELECT count(*) FROM rings WHERE EXISTS (SELECT 1 FROM {TRUE} t WHERE len(list_intersect(members, ids)) / len(members) >= 0.3e0)) AS nr))""",
    "account_profile": "SELECT account_id, owner_name, risk, CASE WHEN risk >= 0.6e0 THEN 'high' WHEN risk >= 0.3e0 THEN 'medium' ELSE 'low' END AS risk_band, verification_level, business_category, ip_country, ip_risk_score, emulator, automation_score, prior_fraud, email, state.status, coalesce(findings, '') AS findings FROM scored JOIN state USING (account_id) LEFT JOIN near_hits USING (account_id)",
    "trace_path": "SELECT d AS hop, src, node AS dst, tx_id, amount_c, us, channel FROM path",
    "trace_flow": "SELECT count(*) > 0 AS found, count(*) AS n_hops, CAST(coalesce(sum(amount_c), 0) AS BIGINT) AS total_c FROM path",
    "circular_long": f"SELECT {joined('members', 'nodes', 'tx_ids')}, length, retention, hours, score, start_us, end_us FROM circular_long",
    "community": "SELECT array_to_string(members, ',') AS members, size, density, score FROM community",
    "community_large": "SELECT array_to_string(members, ',') AS members, size, density, score FROM community_large",
    "community_evidence": f"""SELECT array_to_string(members, ',') AS members, size, {rnd("share", 3)} AS density, {rnd("least(1e0, share)", 2)} AS score FROM (
  SELECT members, size, 2 * m / (size * (size - 1)) AS share FROM (SELECT k // 5 AS c, list_sort(list(account_id)) AS members, count(*) AS size FROM acc GROUP BY 1)
  JOIN (SELECT x.k // 5 AS c, count(*) AS m FROM (SELECT DISTINCT least(src, dst) AS p, greatest(src, dst) AS q FROM tx WHERE src <> dst) JOIN acc x ON p = x.account_id JOIN acc y ON q = y.account_id AND x.k // 5 = y.k // 5 GROUP BY 1) USING (c)
  WHERE size BETWEEN 3 AND 12) WHERE share >= 0.1e0""",
    "ring_findings": """SELECT detector, array_to_string(ids, ',') AS subject_ids, score FROM (SELECT DISTINCT detector, ids, score FROM findings WHERE list_has_any(ids, (SELECT members FROM rings WHERE ring_id = 'DET_001'))
  ORDER BY detector, ids LIMIT 50)""",
    "ring_keys": """SELECT r.ring_id, r.score, CAST(len(r.members) AS INTEGER) AS n_accounts, CAST((SELECT count(*) FROM ring_tx t WHERE t.ring_id = r.ring_id) AS INTEGER) AS n_tx, m.place - 1 AS place, m.account_id, m.risk, a.owner_name
  FROM rings r JOIN (SELECT ring_id, member.account_id, risk, row_number() OVER (PARTITION BY ring_id ORDER BY coalesce(risk, 0e0) DESC, member.account_id) AS place FROM member LEFT JOIN risk USING (account_id)
  QUALIFY row_number() OVER (PARTITION BY ring_id ORDER BY coalesce(risk, 0e0) DESC, member.account_id) <= 3) m USING (ring_id) LEFT JOIN acc a USING (account_id)""",
    "account_findings": "SELECT detector, array_to_string(ids, ',') AS subject_ids, score, coalesce(start_us, 0) AS start_us, coalesce(end_us, 0) AS end_us FROM findings WHERE list_contains(ids, 'A7')",
    "account_signals": "SELECT account_id, risk, detector, score FROM shown JOIN risk USING (account_id) WHERE account_id = 'A7'",
    "verdicts": f"""SELECT account_id, verdict, {NOTE} AS text FROM (SELECT *, CASE WHEN risk >= 0.5e0 THEN 'mule' WHEN risk >= 0.3e0 THEN 'watch' ELSE 'clear' END AS verdict FROM scored)
  LEFT JOIN (SELECT account_id, sum(i) AS i, sum(o) AS o, count(DISTINCT party) FILTER (inn) AS senders, count(DISTINCT party) FILTER (NOT inn) AS recipients FROM sides GROUP BY account_id) USING (account_id)
  LEFT JOIN (SELECT account_id, string_agg(detector || ' ' || printf('%.2f', score), ', ' ORDER BY score DESC, detector) AS signals FROM (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, detector) <= 4) GROUP BY account_id) USING (account_id)
  LEFT JOIN (SELECT account_id, string_agg(flag, ', ' ORDER BY flag) AS flags FROM (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY flag) <= 5) GROUP BY account_id) USING (account_id)""",
    "streaming_bursts": f"""SELECT account_id, start_us, start_us + {72 * H} AS end_us, count(*) AS n, CAST(sum(amount_c) AS BIGINT) AS total_c
  FROM (SELECT dst AS account_id, amount_c, (us // {12 * H} - i) * {12 * H} AS start_us FROM tx, range(6) AS r(i) WHERE amount_c >= 700000 AND amount_c < 1000000)
  WHERE start_us + {72 * H} <= (SELECT max(us) // 1000 * 1000 - {H} FROM tx) GROUP BY account_id, start_us HAVING count(*) >= 3 AND sum(amount_c) >= 1000000""",
    "compare_rings": """SELECT a.ring_id AS ring_a, b.ring_id AS ring_b, array_to_string(list_sort(list_intersect(a.members, b.members)), ',') AS shared_accounts, array_to_string(list_sort(list_intersect(a.patterns, b.patterns)), ',') AS shared_patterns,
  len(list_intersect(a.members, b.members)) AS n_shared, CAST(x.c AS BIGINT) AS amount_c_a, CAST(y.c AS BIGINT) AS amount_c_b FROM rings a JOIN rings b ON a.place < b.place AND len(list_intersect(a.members, b.members)) > 0
  LEFT JOIN (SELECT ring_id, sum(amount_c) AS c FROM ring_tx GROUP BY ring_id) x ON x.ring_id = a.ring_id LEFT JOIN (SELECT ring_id, sum(amount_c) AS c FROM ring_tx GROUP BY ring_id) y ON y.ring_id = b.ring_id""",
    "flow_summary": f"""SELECT *, CASE WHEN total_in_c > 0 THEN {rnd("total_out_c / total_in_c", 2)} END AS passthrough_ratio FROM (SELECT account_id, CAST(sum(i) AS BIGINT) AS total_in_c, CAST(sum(o) AS BIGINT) AS total_out_c, CAST(sum(i) - sum(o) AS BIGINT) AS retained_c,
  count(DISTINCT party) FILTER (inn) AS distinct_senders, count(DISTINCT party) FILTER (NOT inn) AS distinct_recipients, min(us) AS first_us, max(us) AS last_us FROM sides GROUP BY account_id)""",
    "top_counterparties": """SELECT * FROM (SELECT account_id, party, count(*) AS n_tx, CAST(sum(i + o) AS BIGINT) AS total_c, CASE WHEN inn THEN 'in' ELSE 'out' END AS side, row_number() OVER (PARTITION BY account_id, inn ORDER BY sum(i + o) DESC, party) AS place
  FROM sides GROUP BY account_id, party, inn) WHERE place <= 10""",
    "elevated_profile": f"SELECT account_id, attribute, value FROM ({ELEVATED})",
    "search": f"SELECT account_id, {rnd('risk', 3)} AS risk FROM scored WHERE contains(lower(account_type), 'business') AND (lower(country) = 'cy')",
    "risk_tiers": "SELECT CASE WHEN risk >= 0.66e0 THEN 'high' WHEN risk >= 0.33e0 THEN 'med' ELSE 'low' END AS tier, count(*) AS accounts FROM scored GROUP BY 1",
    "signal_categories": f"SELECT *, CAST({PLACE} AS BIGINT) AS place FROM (SELECT account_id, {CATEGORY} AS category, count(*) AS signals, max(score) AS peak FROM shown JOIN risk USING (account_id) GROUP BY 1, 2)",
}


#: Queries on the analysis; each has a form by all detectors.
FULL = {
    "findings", "behaviour_points", "network_association", "account_risk", "ring_seeds", "seed_measures", "summary", "accounts_list", "ego_graph_1", "ego_graph_2", "ego_graph_2_capped", "ego_nodes",
    "suspicious_edges", "enriched_edges", "rings_list", "ring_accounts", "ring_transactions", "ring_findings", "ring_keys", "account_findings", "account_signals", "account_transactions", "transaction_detail",
    "auto_freeze", "decided_status", "decision_log", "risk_order", "table_order", "review_queue", "under_review", "evaluate", "account_profile", "compare_rings", "verdicts", "search", "risk_tiers", "signal_categories",
}
FULL_RINGS = FINALS["rings"].replace("members, ',') AS members", "members, ',') AS account_ids").replace("SELECT ring_id,", "SELECT ring_id, place,", 1).replace(", (SELECT count(*) FROM ring_tx t WHERE t.ring_id = rings.ring_id) AS n_tx", "")


def oracle_sql() -> dict[str, str]:
    found = {name: sql(final) for name, final in FINALS.items()}
    return found | {f"full_{name}": sql(FINALS[name], full=True) for name in FULL} | {"full_rings": sql(FULL_RINGS, full=True)}
