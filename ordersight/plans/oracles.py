"""SQL counterparts of the catalogue, written from the meaning of each operator.

Histories are spelled out as joins of days with all earlier days, as-of values as as-of joins, splits
as a full ranking: none of the shortcuts of the DataFrame code is used here.
"""

from __future__ import annotations

from ordersight.functions import values as V
from ordersight.sources import star

DAYS = list(range(V.LAST_DAY + 1))


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _cluster(column: str, groups: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"WHEN {column} IN ({_quoted(m)}) THEN '{g}'" for g, m in groups.items())
    return f"CASE {cases} ELSE '{default}' END"


RAW = star.RAW_CTES.format(**{t: t for t in star.TABLES})

FLAGS = ["calculationDefinitive", "noCancellation", "noCase", "hasOneCase", "hasMoreCases", "noReturn"]
RULES = {
    "case_before_order": "startDateCase < orderDate",
    "cancellation_before_order": "cancellationDate < orderDate",
    "promise_before_order": "promisedDeliveryDate < orderDate",
    "shipment_before_order": "shipmentDate < orderDate",
    "return_before_order": "returnDateTime < orderDate",
    "cancellation_after_return": "cancellationDate > returnDateTime",
    "order_before_registration": "orderDate < registrationDateSeller",
    "order_after_delivery": "orderDate > CAST(dateTimeFirstDeliveryMoment AS DATE)",
    "cancellation_after_delivery": "cancellationDate > CAST(dateTimeFirstDeliveryMoment AS DATE)",
    "return_before_delivery": "returnDateTime < CAST(CAST(dateTimeFirstDeliveryMoment AS DATE) AS TIMESTAMP)",
    "no_registration": "registrationDateSeller IS NULL",
    "no_promise": "promisedDeliveryDate IS NULL",
}
ANY_RULE = " OR ".join(f"COALESCE({r}, FALSE)" for r in RULES.values())
REPAIRS = {
    "cancellation": "noCancellation AND cancellationDate IS NOT NULL",
    "return": "noReturn AND returnDateTime IS NOT NULL",
    "case": "noCase AND startDateCase IS NOT NULL",
    "quantity": "COALESCE(quantityReturned > quantityOrdered, FALSE)",
    "delivery": "dateTimeFirstDeliveryMoment IS NOT NULL AND onTimeDelivery IS NULL",
}

PASSED = ["orderLineId", "orderDate", "productId", "sellerId", "productTitle", "productGroup",
          "quantityOrdered", "totalPrice", "fulfilmentType", "countryCode", "countryOriginSeller",
          "transporterCode", "registrationDateSeller", "promisedDeliveryDate", "shipmentDate",
          "onTimeDelivery"]

TYPED = f"""
typed AS (SELECT {', '.join(PASSED)}, cancellationDate, cancellationReasonCode, returnDateTime, returnCode,
  startDateCase, cntDistinctCaseIds, quanityReturned AS quantityReturned,
  datetTimeFirstDeliveryMoment AS dateTimeFirstDeliveryMoment,
  {', '.join(f'COALESCE({c}, TRUE) AS {c}' for c in FLAGS)},
  CASE detailedMatchClassification WHEN 'KNOWN HAPPY' THEN 'HAPPY' ELSE detailedMatchClassification END
    AS generalMatchClassification,
  replace(generalMatchClassification, 'KNOWN ', '') AS detailedMatchClassification
  FROM raw_orders),
kept AS (SELECT * FROM typed WHERE NOT ({ANY_RULE})),
repaired AS (SELECT {', '.join(PASSED)}, generalMatchClassification, detailedMatchClassification,
  calculationDefinitive, noCancellation, noReturn, noCase,
  CASE WHEN NOT ({REPAIRS['cancellation']}) THEN cancellationDate END AS cancellationDate,
  CASE WHEN NOT ({REPAIRS['cancellation']}) THEN cancellationReasonCode END AS cancellationReasonCode,
  CASE WHEN NOT ({REPAIRS['return']}) THEN returnDateTime END AS returnDateTime,
  CASE WHEN {REPAIRS['quantity']} THEN quantityOrdered WHEN NOT ({REPAIRS['return']}) THEN quantityReturned END
    AS quantityReturned,
  CASE WHEN NOT ({REPAIRS['return']}) THEN returnCode END AS returnCode,
  CASE WHEN NOT ({REPAIRS['case']}) THEN startDateCase END AS startDateCase,
  CASE WHEN NOT ({REPAIRS['case']}) THEN cntDistinctCaseIds END AS cntDistinctCaseIds,
  CASE WHEN NOT ({REPAIRS['case']}) THEN hasOneCase END AS hasOneCase,
  CASE WHEN NOT ({REPAIRS['case']}) THEN hasMoreCases END AS hasMoreCases,
  CASE WHEN NOT ({REPAIRS['delivery']}) THEN dateTimeFirstDeliveryMoment END AS dateTimeFirstDeliveryMoment
  FROM kept)
"""

OUTCOMES = [(p, c, d) for p in ("", "Return") for c in ("", "Case") for d in ("", "Unknown delivery", "Late delivery")]
CLASSES = ", ".join(
    "({}, {}, '{}', '{}')".format(
        "FALSE" if p else "TRUE", "FALSE" if c else "TRUE",
        {"": "on time", "Unknown delivery": "unknown", "Late delivery": "late"}[d],
        " + ".join(x for x in (p, c, d) if x) or "All good") for p, c, d in OUTCOMES)

PREPARED = f"""
classes(noR, noC, delivery, name) AS (VALUES {CLASSES}),
derived AS (SELECT r.* EXCLUDE (totalPrice),
  CASE WHEN totalPrice > 0 THEN ln(totalPrice) WHEN totalPrice = 0 THEN CAST('-inf' AS DOUBLE) END AS totalPrice,
  CAST(startDateCase - orderDate AS INT) AS caseDays,
  CAST(CAST(returnDateTime AS DATE) - orderDate AS INT) AS returnDays,
  CAST(cancellationDate - orderDate AS INT) AS cancellationDays,
  CAST(CAST(dateTimeFirstDeliveryMoment AS DATE) - orderDate AS INT) AS actualDeliveryDays,
  CAST(shipmentDate - orderDate AS INT) AS shipmentDays,
  CAST(orderDate - registrationDateSeller AS INT) AS partnerSellingDays,
  CAST(promisedDeliveryDate - orderDate AS INT) AS promisedDeliveryDays,
  CAST(year(orderDate) AS INT) AS orderYear, CAST(month(orderDate) AS INT) AS orderMonth,
  CAST(isodow(orderDate) - 1 AS INT) AS orderWeekday,
  orderDate > DATE '{star.FLAG_AFTER}' AS orderCorona, year(orderDate) = {star.FLAG_YEAR} AS orderYear2020,
  {', '.join(f'isodow(orderDate) = {i + 1} AS order{d}' for i, d in enumerate(V.WEEKDAYS))},
  {', '.join(f'month(orderDate) = {i + 1} AS order{m}' for i, m in enumerate(V.MONTHS))},
  CAST(length(productTitle) AS INT) AS productTitleLength,
  COALESCE(fulfilmentType = 'FBB', FALSE) AS fulfilmentByPlatform,
  COALESCE(countryCode = 'NL', FALSE) AS countryCodeNL,
  {', '.join(f"COALESCE(countryOriginSeller = '{c}', FALSE) AS countryOrigin{c}" for c in ('NL', 'BE', 'DE'))},
  CASE WHEN NOT noCancellation THEN 'Cancellation' ELSE k.name END AS determinantClassification,
  CASE WHEN generalMatchClassification = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'KNOWN' END AS binaryMatchClassification,
  {_cluster('transporterCode', V.TRANSPORTERS, V.OTHER_TRANSPORTER)} AS transporterCodeGeneral,
  {_cluster('productGroup', V.PRODUCT_GROUPS, V.OTHER_GROUP)} AS productGroupGeneral
  FROM repaired r LEFT JOIN classes k ON noR = noReturn AND noC = noCase
    AND delivery = CASE WHEN onTimeDelivery IS NULL THEN 'unknown' WHEN onTimeDelivery THEN 'on time' ELSE 'late' END),
prepared AS (SELECT *, {', '.join(f"productGroupGeneral = '{g}' AS {V.group_column(g)}"
                                  for g in [*V.PRODUCT_GROUPS, V.OTHER_GROUP])} FROM derived)
"""

HISTORY = """
pd AS (SELECT productId, orderDate AS day, count(*) AS lines, COALESCE(sum(quantityOrdered), 0) AS q,
         count(quantityOrdered) AS c FROM prepared WHERE productId IS NOT NULL GROUP BY 1, 2),
pt AS (SELECT a.productId, a.day, max(a.lines) AS lines, sum(b.q) AS total, sum(b.c) AS cnt, min(b.day) AS first_day
       FROM pd a JOIN pd b ON b.productId = a.productId AND b.day <= a.day GROUP BY 1, 2),
pr AS (SELECT a.productId, a.day, sum(r.quantityReturned) AS ret
       FROM pd a JOIN prepared r ON r.productId = a.productId AND r.orderDate <= a.day
         AND r.returnDateTime <= CAST(a.day AS TIMESTAMP) GROUP BY 1, 2),
ph AS (SELECT productId, day, CAST(cnt AS DOUBLE) AS productOrderCountX, CAST(total AS DOUBLE) AS productTotalCountX,
         CASE WHEN day = first_day AND lines = 1 THEN 0.0 ELSE COALESCE(ret, 0.0) END AS productTotalReturnedX,
         CASE WHEN day = first_day AND lines = 1 THEN 0.0 ELSE COALESCE(ret, 0.0) END / NULLIF(total, 0)
           AS productReturnFractionX
       FROM pt LEFT JOIN pr USING (productId, day)),
sd AS (SELECT sellerId, orderDate AS day, count(quantityOrdered) AS c FROM prepared
       WHERE sellerId IS NOT NULL GROUP BY 1, 2),
sr AS (SELECT a.sellerId, a.day, ln(sum(b.c) / (a.day - min(b.day) + 1)) AS rate
       FROM sd a JOIN sd b ON b.sellerId = a.sellerId AND b.day <= a.day GROUP BY a.sellerId, a.day)
"""


def _product_x(x: int) -> str:
    return f"""SELECT a.productId, a.day, b.productOrderCountX, b.productTotalCountX, b.productTotalReturnedX,
      b.productReturnFractionX FROM ph a ASOF JOIN ph b ON a.productId = b.productId AND a.day + {x} >= b.day"""


def _seller_x(x: int) -> str:
    return f"""SELECT a.sellerId, a.day, b.rate FROM sr a ASOF JOIN sr b
      ON a.sellerId = b.sellerId AND a.day + {x} >= b.day"""


def _historic_days(variable: str) -> str:
    return f"""SELECT COALESCE(CAST({variable} AS VARCHAR), 'UNKNOWN') AS key, orderDate AS day,
      CAST(count(*) FILTER (generalMatchClassification = 'HAPPY') AS DOUBLE) AS h,
      CAST(count(*) FILTER (generalMatchClassification = 'UNHAPPY') AS DOUBLE) AS u,
      CAST(count(*) FILTER (generalMatchClassification = 'UNKNOWN') AS DOUBLE) AS k
      FROM prepared GROUP BY 1, 2"""


def _historic_x(variable: str, x: int, days: str) -> str:
    """``days`` names the table of counts per key and day."""
    def share(c: str) -> str:
        return f"COALESCE(round_even(sum(b.{c}) / NULLIF(sum(b.h + b.u + b.k), 0) * 100 * 100, 0) / 100, 0)"
    return f"""SELECT a.key, a.day, {share('h')} AS {variable}HistoricHappyX,
      {share('u')} AS {variable}HistoricUnhappyX, {share('k')} AS {variable}HistoricUnknownX
      FROM {days} a LEFT JOIN {days} b ON b.key = a.key AND b.day + {V.OUTCOME_DELAY} <= a.day + {x}
      GROUP BY a.key, a.day"""


HISTORIC = ", ".join(f"hd_{v} AS MATERIALIZED ({_historic_days(v)})" for v in V.HISTORY_VARIABLES)


def _known_x(x: int) -> str:
    flags = [f"COALESCE({d}Days <= {x}, FALSE) AS {d}KnownX" for d in ("case", "return", "cancellation")]
    flags += [f"COALESCE(actualDeliveryDays <= {x} AND onTimeDelivery = {v}, FALSE) AS {n}DeliveryKnownX"
              for v, n in (("TRUE", "onTime"), ("FALSE", "late"))]
    flags += [f"COALESCE(shipmentDays <= {x} AND transporterCodeGeneral = '{t}', FALSE) AS \"transporter{t}/X\""
              for t in ("POSTNL", "DHL", "DPD", "BRIEF", "OTHER")]
    return ", ".join(flags)


def _matrix(x: int) -> str:
    features = ", ".join(f'"{f}"' for f in V.FEATURES)
    joins = "\n".join(
        f"LEFT JOIN ({_historic_x(v, x, 'hd_' + v)}) {v}_h ON {v}_h.key = COALESCE(CAST(p.{v} AS VARCHAR), 'UNKNOWN')"
        f" AND {v}_h.day = p.orderDate" for v in V.HISTORY_VARIABLES)
    complete = " AND ".join(f'"{f}" IS NOT NULL' for f in [*V.FEATURES, V.LABEL, V.DATE])
    return f"""SELECT orderLineId, orderDate, {features}, detailedMatchClassification FROM (
      SELECT p.*, {_known_x(x)}, px.* EXCLUDE (productId, day), sx.rate AS sellerDailyOrdersX,
        {', '.join(f'{v}_h.* EXCLUDE (key, day)' for v in V.HISTORY_VARIABLES)}
      FROM prepared p LEFT JOIN ({_product_x(x)}) px ON px.productId = p.productId AND px.day = p.orderDate
      LEFT JOIN ({_seller_x(x)}) sx ON sx.sellerId = p.sellerId AND sx.day = p.orderDate
      {joins}) t WHERE {complete}"""


# --- tree, scores, predictions --------------------------------------------------------------

TREE = """
edges(node, parent) AS (VALUES ('UNKNOWN', 'ORDERS'), ('KNOWN', 'ORDERS'), ('HAPPY', 'KNOWN'), ('UNHAPPY', 'KNOWN'),
  ('MILDLY UNHAPPY', 'UNHAPPY'), ('MEDIUM UNHAPPY', 'UNHAPPY'), ('HEAVILY UNHAPPY', 'UNHAPPY')),
names(node) AS (SELECT node FROM edges UNION SELECT 'ORDERS'),
closure(node, ancestor, distance) AS (
  SELECT node, node, 0 FROM names UNION ALL
  SELECT c.node, e.parent, c.distance + 1 FROM closure c JOIN edges e ON e.node = c.ancestor),
leaves AS (SELECT node FROM names WHERE node NOT IN (SELECT parent FROM edges)),
sets AS (SELECT node, ancestor AS member FROM closure WHERE ancestor <> 'ORDERS' OR node = 'ORDERS'),
pairs AS (
  SELECT a.node AS label, b.node AS pred,
    (SELECT count(*) FROM sets x JOIN sets y ON x.member = y.member WHERE x.node = a.node AND y.node = b.node) AS common,
    (SELECT count(*) FROM sets x WHERE x.node = a.node) AS t,
    (SELECT count(*) FROM sets x WHERE x.node = b.node) AS p,
    (SELECT min(x.distance + y.distance) FROM closure x JOIN closure y ON x.ancestor = y.ancestor
      WHERE x.node = a.node AND y.node = b.node) AS distance
  FROM names a, names b)
"""


def _scores(days: list[int]) -> str:
    lines = ("(SELECT orderLineId, generalMatchClassification, h, day FROM raw_orders, "
             f"(VALUES {', '.join(f'({d})' for d in days)}) v(day))")
    return f"scores AS ({star.SCORE_SELECT.format(lines=lines)})"


def _score(node: str) -> str:
    return "p_" + node.replace(" ", "_")


STAGES = [("ORDERS", ["KNOWN", "UNKNOWN"]), ("KNOWN", ["HAPPY", "UNHAPPY"]),
          ("UNHAPPY", ["HEAVILY UNHAPPY", "MEDIUM UNHAPPY", "MILDLY UNHAPPY"])]


def _route(thresholds: dict[str, float] | float | None) -> str:
    """Nested CASE: the decision at a node, followed by the decision at its winning child."""
    kids = dict(STAGES)

    def decide(node: str) -> str:
        if node not in kids:
            return f"'{node}'"
        cases = []
        for i, c in enumerate(kids[node]):
            wins = " AND ".join(f"{_score(c)} {'>' if kids[node].index(o) < i else '>='} {_score(o)}"
                                for o in kids[node] if o != c)
            limit = thresholds.get(c) if isinstance(thresholds, dict) else thresholds
            if limit is None:
                cases.append(f"WHEN {wins} THEN {decide(c)}")
            else:
                cases.append(f"WHEN {wins} AND {_score(c)} >= CAST({limit} AS DOUBLE) THEN {decide(c)}")
        return f"CASE {' '.join(cases)} ELSE '{node}' END"
    return decide("ORDERS")


def _history(fixed: dict[str, float]) -> str:
    return f"""
{_scores(DAYS)},
routed AS MATERIALIZED (SELECT orderLineId, day, label,
  CASE WHEN day = {V.LAST_DAY} THEN {_route(None)} ELSE {_route(fixed)} END AS pred FROM scores),
followed AS (SELECT *, lag(pred) OVER k AS before,
    min(CASE WHEN pred IN ('UNKNOWN', 'HAPPY', 'MILDLY UNHAPPY', 'MEDIUM UNHAPPY', 'HEAVILY UNHAPPY') THEN day END)
      OVER (PARTITION BY orderLineId) AS decided_on
  FROM routed WINDOW k AS (PARTITION BY orderLineId ORDER BY day)),
history AS MATERIALIZED (SELECT orderLineId, day, label, pred,
    CASE WHEN before IN ('KNOWN', 'UNHAPPY') THEN before END AS prev FROM followed WHERE day <= decided_on),
hp AS (SELECT h.*, common, t, p, distance, pred IN (SELECT node FROM leaves) AS leaf,
         pred IN ('KNOWN', 'UNHAPPY') AS block,
         (SELECT count(*) > 0 FROM closure c WHERE c.node = h.pred AND c.ancestor = h.prev) AS inside
       FROM history h JOIN pairs USING (label, pred))"""


def _prf(group: str, source: str, key: str) -> str:
    return f"""SELECT {key}, rows, common_sum, true_sum, pred_sum, common_sum / pred_sum AS precision,
      common_sum / true_sum AS recall, CASE WHEN common_sum = 0 THEN 0.0 ELSE 2.0 * (common_sum / pred_sum)
        * (common_sum / true_sum) / ((common_sum / pred_sum) + (common_sum / true_sum)) END AS f_score
      FROM (SELECT {group}, CAST(count(*) AS BIGINT) AS rows, CAST(sum(common) AS BIGINT) AS common_sum,
        CAST(sum(t) AS BIGINT) AS true_sum, CAST(sum(p) AS BIGINT) AS pred_sum FROM {source} GROUP BY ALL)"""


def _daily_report() -> str:
    """One SELECT per metric over the history; totals look back over all earlier days."""
    nodes = ["UNKNOWN", "HAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY", "KNOWN", "UNHAPPY"]
    below = {"ORDERS": ["ORDERS", *nodes], "KNOWN": [n for n in nodes if n != "UNKNOWN"],
             "UNHAPPY": [n for n in nodes if n.endswith("UNHAPPY")]}

    def q(a: str, b: str, condition: str) -> str:
        return (f"CAST(sum({a}) FILTER ({condition}) AS DOUBLE) / "
                f"NULLIF(sum({b}) FILTER ({condition}), 0)")

    def f1(condition: str) -> str:
        p, r = q("common", "p", condition), q("common", "t", condition)
        return f"CASE WHEN {p} = 0 OR {r} = 0 THEN 0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"

    one = {("N_classified", None): "count(*) FILTER (leaf)", ("N_predicted", None): "count(*)",
           ("leaf_accuracy", None): q("CASE WHEN label = pred THEN 1 ELSE 0 END", "1", "leaf"),
           ("tree_error", None): q("distance", "1", "leaf"),
           ("block_Nchange", None): q("CASE WHEN inside THEN 0 ELSE 1 END", "1", "prev IS NOT NULL"),
           ("block_Pchange", None): q("CASE WHEN inside AND pred <> prev THEN 1 ELSE 0 END", "1", "prev IS NOT NULL")}
    for name, condition in (("leaf", "leaf"), ("label", "leaf OR block"), ("block", "block")):
        one[f"{name}_precision", None] = q("common", "p", condition)
        one[f"{name}_recall", None] = q("common", "t", condition)
    for n in nodes:
        one["precision", n] = q("common", "p", f"pred = '{n}'")
        one["recall", n] = q("common", "t", f"pred = '{n}'")
        one["f1", n] = f1(f"pred = '{n}'")
    total = {("%classified", None): "CAST(count(*) FILTER (leaf) AS DOUBLE) / (SELECT count(*) FROM hp WHERE day = 0)",
             ("total_leaf_accuracy", None): one["leaf_accuracy", None],
             ("total_leaf_precision", None): one["leaf_precision", None],
             ("total_leaf_recall", None): one["leaf_recall", None]}
    still = "(SELECT count(*) FILTER (leaf) FROM hp z WHERE z.day <= hp.day) < (SELECT count(*) FROM hp z WHERE z.day = 0)"
    for s, members in below.items():
        came = f"pred IN ({_quoted(members)})"
        one["%blocking", s] = f"CASE WHEN {still} THEN {q(f'CASE WHEN pred = {chr(39)}{s}{chr(39)} THEN 1 ELSE 0 END', '1', came)} END"
        one["%Tblocking", s] = (f"CASE WHEN {still} AND count(*) FILTER ({came}) > 0 "
                                f"THEN count(*) FILTER (pred = '{s}') END")

    def select(m, n, v, source) -> str:
        node = f"'{n}'" if n else "CAST(NULL AS VARCHAR)"
        return f"SELECT day, '{m}' AS metric, {node} AS node, CAST({v} AS DOUBLE) AS value FROM {source} GROUP BY day"
    parts = [select(m, n, v, "hp") for (m, n), v in one.items()]
    parts += [select(m, n, v, "(SELECT d.day, hp.* EXCLUDE (day) FROM (SELECT DISTINCT day FROM hp) d "
                     "JOIN hp ON hp.day <= d.day)") for (m, n), v in total.items()]
    return " UNION ALL ".join(parts)


def _thresholds(flat: bool) -> str:
    """Every candidate of every node against every vote."""
    leaves = ["UNKNOWN", "HAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"]
    stages = [("ORDERS", leaves)] if flat else STAGES
    under = {"KNOWN": leaves[1:], "UNHAPPY": leaves[2:]}
    votes = []
    for _, kids in stages:
        members = [x for k in kids for x in under.get(k, [k])]
        for k in kids:
            wins = " AND ".join(f"{_score(k)} > {_score(o)}" for o in kids if o != k)
            votes.append(f"SELECT '{k}' AS node, {_score(k)} AS s, label IN ({_quoted(under.get(k, [k]))}) AS pos "
                         f"FROM scores WHERE label IN ({_quoted(members)}) AND {wins}")
    return f"""
votes AS MATERIALIZED ({' UNION ALL '.join(votes)}),
bound AS (SELECT node, COALESCE(quantile_cont(s, {V.CERTAINTY}) FILTER (NOT pos), min(s)) AS lb,
            count(*) FILTER (pos) AS npos, max(s) AS hi FROM votes GROUP BY node),
span AS (SELECT v.node, min(s) AS lo, max(hi) AS hi, max(npos) AS npos
         FROM votes v JOIN bound b ON b.node = v.node AND v.s >= b.lb GROUP BY v.node),
cand AS (SELECT node, npos, i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99) + lo END AS threshold
         FROM span, range(100) r(i)),
tallied AS (SELECT node, s, count(*) FILTER (pos) AS np, count(*) AS na FROM votes GROUP BY node, s),
rated AS (SELECT c.node, c.i, c.threshold, max(npos) AS npos, sum(np) AS np, sum(na) AS na
          FROM cand c JOIN tallied v ON v.node = c.node AND v.s >= c.threshold GROUP BY 1, 2, 3),
scored AS (SELECT node, i, threshold,
   CASE WHEN np = 0 THEN 0 ELSE 2 * (np / na) * (np / npos) / ((np / na) + (np / npos)) END AS f FROM rated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f DESC, i) AS rn FROM scored)"""


FLAT_VIEW = """
counts AS (SELECT label, pred, count(*) AS n FROM (SELECT label, {route} AS pred FROM scores) GROUP BY 1, 2),
class_names AS (SELECT label AS class FROM counts UNION SELECT pred FROM counts),
per_class AS (
  SELECT class, COALESCE(tp / NULLIF(predicted, 0), 0) AS precision, COALESCE(tp / NULLIF(actual, 0), 0) AS recall,
    COALESCE(2 * tp / NULLIF(predicted + actual, 0), 0) AS f1, CAST(actual AS BIGINT) AS support
  FROM (SELECT class, COALESCE((SELECT sum(n) FROM counts WHERE label = class AND pred = class), 0) AS tp,
      COALESCE((SELECT sum(n) FROM counts WHERE label = class), 0) AS actual,
      COALESCE((SELECT sum(n) FROM counts WHERE pred = class), 0) AS predicted FROM class_names)),
overall AS (
  SELECT (SELECT CAST(sum(n) FILTER (label = pred) AS DOUBLE) / sum(n) FROM counts) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision,
    sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1,
    CAST(sum(support) AS BIGINT) AS support FROM per_class)
"""


def sql() -> dict[str, str]:
    from ordersight.plans.catalog import DYNAMIC, FIXED, LOOK_AHEAD, NUMERIC, REPAIRED

    def w(select: str, *ctes: str, rounded=(), dates=(), recursive: bool = False) -> str:
        out = [f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates] + [f'ROUND("{c}", 6) AS "{c}"' for c in rounded]
        if out:
            select = f"SELECT * REPLACE ({', '.join(out)}) FROM ({select})"
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((RAW, *ctes))} {select}"

    cleaned = (TYPED, PREPARED)
    histories = (*cleaned, HISTORY)
    everything = (*histories, HISTORIC)

    def prepared(*columns, rounded=()):
        return w(f"SELECT orderLineId, {', '.join(columns)} FROM prepared", *cleaned, rounded=rounded)

    def historic(v: str) -> str:
        xs = " UNION ALL ".join(f"SELECT {x} AS x, * FROM ({_historic_x(v, x, 'hd_' + v)})" for x in [0, *LOOK_AHEAD])
        return w(xs, *everything, dates=["day"], rounded=[f for f in V.HISTORY_X if f.startswith(v)])

    def split(burn_in: str, end: str, last: str) -> str:
        return w(f"""SELECT orderLineId, CASE WHEN pos < {burn_in} THEN 'burn_in' WHEN pos < {end} THEN 'train'
            ELSE '{last}' END AS split FROM (SELECT *, row_number() OVER (ORDER BY orderDate, orderLineId) - 1 AS pos,
            count(*) OVER () AS n FROM prepared)""", *cleaned)

    e8, e1 = "floor(CAST(0.8 AS DOUBLE) * n)", "floor(CAST(0.1 AS DOUBLE) * n)"
    burn = f"floor(CAST(0.1 AS DOUBLE) * {e8})"
    tree = (TREE,)
    hist = (TREE, _history(FIXED))
    flat_scores = (_scores([3]), FLAT_VIEW.format(route=_route(None)))
    raw_columns = [*PASSED, "datetTimeFirstDeliveryMoment", "cancellationDate", "cancellationReasonCode",
                   "noCancellation", "returnDateTime", "quanityReturned", "returnCode", "noReturn", "startDateCase",
                   "cntDistinctCaseIds", "hasOneCase", "hasMoreCases", "noCase", "calculationDefinitive",
                   "generalMatchClassification", "detailedMatchClassification"]
    raw_dates = ["orderDate", "registrationDateSeller", "promisedDeliveryDate", "shipmentDate",
                 "datetTimeFirstDeliveryMoment", "cancellationDate", "returnDateTime", "startDateCase"]
    counted = ["determinantClassification", "transporterCodeGeneral", "productGroupGeneral", "transporterCode"]
    offsets = ["caseDays", "returnDays", "cancellationDays", "promisedDeliveryDays", "actualDeliveryDays"]
    per_offset = ", ".join(
        f"{m}_c AS (SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS DOUBLE) / "
        f"(SELECT count({'*' if m == 'actualDeliveryDays' else m}) FROM prepared) AS share FROM "
        f"(SELECT {m} AS day, count(*) AS n FROM prepared WHERE {m} IS NOT NULL GROUP BY 1))" for m in offsets)
    matrix_doubles = [f for f in V.FEATURES if f in NUMERIC and f not in ("productTitleLength", "promisedDeliveryDays",
                                                                          "partnerSellingDays")]
    stage_rows = " UNION ALL ".join(
        f"SELECT orderLineId, '{s}' AS stage, ancestor AS target FROM prepared JOIN closure "
        f"ON node = detailedMatchClassification AND ancestor IN ({_quoted(kids)})" for s, kids in STAGES)
    report = w(_daily_report(), *hist, rounded=["value"], recursive=True)
    report_nodes = {"precision": "precision", "recall": "recall", "f_score": "f_score"}
    blocking = " UNION ALL ".join(
        f"SELECT '{s}' AS stage, count(*) FILTER (pred IN ({_quoted(m)})) AS scored, "
        f"count(*) FILTER (pred = '{s}') AS blocked FROM r" for s, m in {
            "ORDERS": ["ORDERS", "UNKNOWN", "KNOWN", "HAPPY", "UNHAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"],
            "KNOWN": ["KNOWN", "HAPPY", "UNHAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"],
            "UNHAPPY": ["UNHAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"]}.items())
    return {
        "scan_orders": w(f"SELECT {', '.join(raw_columns)} FROM raw_orders", dates=raw_dates, rounded=["totalPrice"]),
        "union_years": w("SELECT orderLineId, orderDate, productId, totalPrice FROM raw_orders",
                         dates=["orderDate"], rounded=["totalPrice"]),
        "write_prepared": w("""SELECT orderYear, count(*) AS n, sum(quantityOrdered) AS units,
            count(*) FILTER (onTimeDelivery) AS on_time, CAST(max(returnDateTime) AS VARCHAR) AS last_return
            FROM prepared GROUP BY 1""", *cleaned),
        "rename_recode": w("""SELECT orderLineId, generalMatchClassification, detailedMatchClassification,
            quantityReturned, CAST(dateTimeFirstDeliveryMoment AS VARCHAR) AS dateTimeFirstDeliveryMoment FROM typed""", TYPED),
        "cast_flags": w(f"SELECT orderLineId, {', '.join(FLAGS)} FROM typed", TYPED),
        "noise_removed": w("SELECT orderLineId, orderDate, productId FROM kept", TYPED, dates=["orderDate"]),
        "noise_by_rule": w(" UNION ALL ".join(
            f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n FROM typed" for n, r in {**RULES, "any": ANY_RULE}.items()), TYPED),
        "cleaning_report": w(" UNION ALL ".join(
            ["SELECT 'records' AS item, count(*) AS n FROM typed", "SELECT 'kept', count(*) FROM kept",
             f"SELECT 'removed', count(*) FROM typed WHERE {ANY_RULE}"]
            + [f"SELECT 'repaired_{n}', count(*) FROM kept WHERE {r}" for n, r in REPAIRS.items()]), TYPED),
        "repaired_orders": w(f"SELECT orderLineId, {', '.join(REPAIRED)} FROM repaired", TYPED, dates=[
            "cancellationDate", "dateTimeFirstDeliveryMoment", "returnDateTime", "startDateCase"]),
        "log_price": prepared("totalPrice", rounded=["totalPrice"]),
        "day_offsets": prepared("caseDays", "returnDays", "cancellationDays", "actualDeliveryDays", "shipmentDays",
                                "partnerSellingDays", "promisedDeliveryDays"),
        "calendar_parts": prepared("orderYear", "orderMonth", "orderWeekday", "orderCorona"),
        "calendar_onehot": prepared(*V.WEEK, *V.MONTH, *V.YEAR),
        "order_flags": prepared("productTitleLength", "fulfilmentByPlatform", "countryCodeNL", "countryOriginNL",
                                "countryOriginBE", "countryOriginDE"),
        "determinant_class": prepared("determinantClassification"),
        "binary_class": prepared("binaryMatchClassification"),
        "transporter_cluster": prepared("transporterCode", "transporterCodeGeneral"),
        "product_group_cluster": prepared("productGroup", "productGroupGeneral"),
        "group_onehot": prepared(*V.GROUP),
        "value_counts": w(" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c} AS \"value\", count(*) AS n FROM prepared GROUP BY 2" for c in counted), *cleaned),
        "determinant_availability": w(
            "SELECT day, " + ", ".join(f"{m}_c.n AS {m}_n, {m}_c.share AS {m}_share" for m in offsets)
            + " FROM " + f"{offsets[0]}_c " + " ".join(f"FULL JOIN {m}_c USING (day)" for m in offsets[1:]),
            *cleaned, per_offset, rounded=[f"{m}_share" for m in offsets]),
        "product_history_0": w("SELECT * FROM ph", *histories, dates=["day"], rounded=V.PRODUCT_X),
        "asof_product_x": w(" UNION ALL ".join(f"SELECT {x} AS x, * FROM ({_product_x(x)})" for x in LOOK_AHEAD),
                            *histories, dates=["day"], rounded=V.PRODUCT_X),
        "seller_rate_0": w("SELECT CAST(sellerId AS VARCHAR) AS key, day, rate FROM sr", *histories,
                           dates=["day"], rounded=["rate"]),
        "asof_seller_x": w(" UNION ALL ".join(
            f"SELECT {x} AS x, CAST(sellerId AS VARCHAR) AS key, day, rate AS value FROM ({_seller_x(x)})"
            for x in LOOK_AHEAD), *histories, dates=["day"], rounded=["value"]),
        "historic_transporter_x": historic("transporterCode"),
        "historic_seller_x": historic("sellerId"),
        "historic_product_group_x": historic("productGroup"),
        "known_flags_x": w(" UNION ALL ".join(f"SELECT orderLineId, {x} AS x, {_known_x(x)} FROM prepared"
                                              for x in [0, *LOOK_AHEAD]), *cleaned),
        "feature_matrix_0": w(_matrix(0), *everything, dates=["orderDate"], rounded=matrix_doubles),
        "feature_matrix_5": w(_matrix(5), *everything, dates=["orderDate"], rounded=matrix_doubles),
        "feature_matrix_all_days": w(" UNION ALL ".join(
            f"SELECT {x} AS day, count(*) AS n, "
            + ", ".join(f'avg(CAST("{f}" AS DOUBLE)) AS "{f}"' for f in DYNAMIC) + f" FROM ({_matrix(x)})"
            for x in DAYS), *everything, rounded=DYNAMIC),
        "minmax_scaled": w(
            "SELECT orderLineId, split, " + ", ".join(
                f"(CAST({f} AS DOUBLE) - min({f}) FILTER (split = 'train') OVER ()) / COALESCE(NULLIF("
                f"CAST(max({f}) FILTER (split = 'train') OVER () - min({f}) FILTER (split = 'train') OVER () AS DOUBLE), 0), 1) AS {f}"
                for f in NUMERIC) + " FROM parted", *everything,
            f"parted AS (SELECT *, CASE WHEN pos < {burn} THEN 'burn_in' WHEN pos < {e8} THEN 'train' ELSE 'test' END AS split "
            f"FROM (SELECT *, row_number() OVER (ORDER BY orderDate, orderLineId) - 1 AS pos, count(*) OVER () AS n "
            f"FROM ({_matrix(0)})))", rounded=NUMERIC),
        "temporal_split": split(burn, e8, "test"),
        "validation_split": split(e1, f"{e1} + floor(CAST(0.8 AS DOUBLE) * (n - {e1}))", "validation"),
        "seeded_sample": w(f"""SELECT orderLineId FROM (SELECT *, row_number() OVER (ORDER BY
            md5(concat(orderLineId, ':1')), orderLineId) AS draw FROM (SELECT *, count(*) OVER () AS n,
            row_number() OVER (ORDER BY orderDate, orderLineId) - 1 AS pos FROM prepared) WHERE pos < {e8})
            WHERE draw <= n // 4""", *cleaned),
        "tree_closure": w("""SELECT ancestor, CAST(sum(n) AS BIGINT) AS n, count(*) AS labels,
            CAST(max(distance) AS INT) AS height
            FROM (SELECT detailedMatchClassification AS node, count(*) AS n FROM prepared GROUP BY 1)
            JOIN closure USING (node) GROUP BY 1""", *cleaned, *tree, recursive=True),
        "tree_distance": w("SELECT orderLineId, day, CAST(distance AS INT) AS distance FROM hp", *hist, recursive=True),
        "stage_targets": w(stage_rows, *cleaned, *tree, recursive=True),
        "class_weights": w(f"""SELECT stage, target, n, CAST(sum(n) OVER (PARTITION BY stage) AS DOUBLE)
            / (count(*) OVER (PARTITION BY stage) * n) AS weight
            FROM (SELECT stage, target, count(*) AS n FROM ({stage_rows}) GROUP BY 1, 2)""",
                           *cleaned, *tree, rounded=["weight"], recursive=True),
        "route_by_threshold": w(f"SELECT orderLineId, {_route(FIXED)} AS pred FROM scores", _scores([3])),
        "route_global": w(f"SELECT *, CAST(blocked AS DOUBLE) / NULLIF(scored, 0) AS share FROM ({blocking})", _scores([3]),
                          f"r AS (SELECT {_route(0.6)} AS pred FROM scores)", rounded=["share"]),
        "carry_over": w("SELECT orderLineId, day, label, pred, prev FROM history", *hist, recursive=True),
        "cat_thresholds": w("SELECT node, threshold, f AS f_score, CAST(i AS INT) AS candidate FROM ranked WHERE rn = 1",
                            _scores([3]), _thresholds(False), rounded=["threshold", "f_score"]),
        "flat_thresholds": w("SELECT node, threshold, f AS f_score, CAST(i AS INT) AS candidate FROM ranked WHERE rn = 1",
                             _scores([3]), _thresholds(True), rounded=["threshold", "f_score"]),
        "hier_prf": w(_prf("day", "hp", "day"), *hist, rounded=list(report_nodes), recursive=True),
        "hier_prf_by_label": w(_prf("day, pred AS node", "hp", "day, node"), *hist, rounded=list(report_nodes), recursive=True),
        "tree_error": w("SELECT day, avg(distance) AS tree_error, count(*) AS rows FROM hp GROUP BY 1", *hist,
                        rounded=["tree_error"], recursive=True),
        "block_change": w("""SELECT day, count(*) AS rows, avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) AS outside,
            avg(CASE WHEN inside AND pred <> prev THEN 1.0 ELSE 0.0 END) AS deeper
            FROM hp WHERE prev IS NOT NULL GROUP BY 1""", *hist, rounded=["outside", "deeper"], recursive=True),
        "flat_scores": w("SELECT * FROM overall", *flat_scores, rounded=[
            "accuracy", *[f"{k}_{m}" for k in ("macro", "weighted") for m in ("precision", "recall", "f1")]]),
        "class_scores": w("SELECT * FROM per_class", *flat_scores, rounded=["precision", "recall", "f1"]),
        "class_report": w("""SELECT * FROM per_class UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, support FROM overall
            UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, support FROM overall
            UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support FROM overall""",
                          *flat_scores, rounded=["precision", "recall", "f1"]),
        "daily_report": report,
        "write_metrics": report,
    }
