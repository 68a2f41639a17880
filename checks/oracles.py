"""One SQL statement per query, for DuckDB over the same Parquet tables."""

from __future__ import annotations

CATEGORIES = (
    "Retail",
    "Electronics",
    "Grocery",
    "Restaurants",
    "Travel",
    "Health & Wellness",
    "Fashion",
    "Entertainment",
    "Education",
    "Online Services",
)
BANKS = (
    "HDFC Bank",
    "ICICI Bank",
    "State Bank of India",
    "Axis Bank",
    "Kotak Mahindra Bank",
)
STATUSES = ("Completed", "Pending", "Failed", "Refunded", "Disputed")


def _case(subject: str, options, first: int = 0) -> str:
    arms = " ".join(
        f"WHEN {subject} = {i} THEN '{name}'" for i, name in enumerate(options, first)
    )
    return f"CASE {arms} END"


def _padded(prefix: str, key: str, width: int) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"'{prefix}' || lpad({text}, CAST(greatest({width}, length({text})) AS INTEGER), '0')"


_DIGIT = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_CUSTOMER = _padded("C", "{0}", 8)
_CARD = _padded("CARD", "o_custkey", 8) + f" || '-' || CAST({_DIGIT} AS VARCHAR)"
_TYPE = f"CASE WHEN (o_custkey + {_DIGIT}) % 2 = 0 THEN 'Credit' ELSE 'Debit' END"
_BANK = _case(_DIGIT, BANKS, 1)
_BUCKET = "((order_key * 7 + part_key * 13 + supp_key) % 100)"

_LINES = """
lines AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number,
         l_partkey AS part_key, l_suppkey AS supp_key,
         l_returnflag AS return_flag, l_linestatus AS line_status,
         CAST(l_shipdate AS DATE) AS transaction_date, l_extendedprice AS amount
  FROM lineitem
),
firsts AS (
  SELECT order_key, line_number, part_key, supp_key, return_flag, line_status,
         transaction_date, CAST(amount AS DECIMAL(12, 2)) AS amount
  FROM (
    SELECT *, row_number() OVER (
      PARTITION BY order_key, line_number
      ORDER BY transaction_date, amount, part_key, supp_key, return_flag, line_status
    ) AS rn
    FROM lines
  ) ranked
  WHERE rn = 1 AND amount > 0
),
places AS (
  SELECT n_nationkey, n_name AS city, r_name AS state
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def _described(source: str) -> str:
    return f"""
  SELECT {_padded('TXN', '(order_key * 10 + line_number)', 12)} AS transaction_id,
         {_CARD} AS card_id,
         {_CUSTOMER.format('o_custkey')} AS customer_id,
         {_padded('M', 'supp_key', 6)} AS merchant_id,
         s_name AS merchant_name,
         {_case('supp_key % 10', CATEGORIES)} AS merchant_category,
         transaction_date, amount, 'INR' AS currency,
         CASE line_number WHEN 1 THEN 'Refund' WHEN 2 THEN 'Bill Payment'
              WHEN 3 THEN 'Wallet Top-up' WHEN 4 THEN 'Merchant Payment'
              ELSE 'Purchase' END AS transaction_type,
         CASE WHEN {_BUCKET} < 72 THEN 'Completed' WHEN {_BUCKET} < 84 THEN 'Pending'
              WHEN {_BUCKET} < 92 THEN 'Failed' WHEN {_BUCKET} < 98 THEN 'Refunded'
              ELSE 'Disputed' END AS transaction_status,
         CASE WHEN return_flag = 'A' THEN 'Chip' WHEN return_flag = 'N' THEN 'Contactless'
              WHEN line_status = 'F' THEN 'Online' ELSE 'EMV' END AS payment_method,
         shop.city AS merchant_city, shop.state AS merchant_state,
         {_BANK} AS bank_name, {_TYPE} AS card_type,
         home.city AS customer_city, home.state AS customer_state,
         'Part ' || CAST(part_key AS VARCHAR) AS description, part_key
  FROM {source}
  LEFT JOIN orders ON o_orderkey = order_key
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN places home ON home.n_nationkey = c_nationkey
  LEFT JOIN supplier ON s_suppkey = supp_key
  LEFT JOIN places shop ON shop.n_nationkey = s_nationkey"""


_TX = f"""{_LINES},
described AS ({_described('firsts')}
),
tx AS (
  SELECT * EXCLUDE (part_key), strftime(transaction_date, '%Y-%m') AS transaction_month,
         transaction_status = 'Completed' AS is_successful,
         transaction_status = 'Failed' AS is_failure
  FROM described
)"""

_DIMENSIONS = f"""
customers AS (
  SELECT {_CUSTOMER.format('c_custkey')} AS customer_id, c_name AS first_name,
         'Family' || CAST(c_custkey % 1000 AS VARCHAR) AS last_name,
         CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
         CAST(18 + c_custkey % 53 AS INTEGER) AS age,
         'customer' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         {_padded('', 'c_custkey', 10)} AS phone, city, state,
         c_mktsegment AS occupation,
         CAST(300000 + (CAST(c_acctbal AS DECIMAL(12, 2)) + 1000) * 245
              AS DECIMAL(12, 2)) AS annual_income,
         DATE '2023-10-08' + CAST(c_custkey % 1095 AS INTEGER) AS registration_date,
         c_acctbal AS balance
  FROM customer LEFT JOIN places ON n_nationkey = c_nationkey
),
cards AS (
  SELECT DISTINCT {_CARD} AS card_id, {_CUSTOMER.format('o_custkey')} AS customer_id,
         {_TYPE} AS card_type, {_BANK} AS bank_name, 'Visa' AS card_network,
         DATE '2023-10-08' + CAST((o_custkey * 5 + {_DIGIT}) % 1095 AS INTEGER)
           AS issue_date,
         DATE '2027-10-07' + CAST((o_custkey * 3 + {_DIGIT}) % 1825 AS INTEGER)
           AS expiry_date,
         CASE (o_custkey + {_DIGIT}) % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Blocked'
              ELSE 'Expired' END AS card_status
  FROM orders
),
merchants AS (
  SELECT {_padded('M', 's_suppkey', 6)} AS merchant_id, s_name AS merchant_name,
         {_case('s_suppkey % 10', CATEGORIES)} AS merchant_category, city, state,
         'Contact ' || CAST(s_suppkey AS VARCHAR) AS contact_person,
         'merchant' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email,
         {_padded('', 's_suppkey', 10)} AS phone,
         DATE '2021-10-08' + CAST(s_suppkey % 1825 AS INTEGER) AS registration_date,
         CASE s_suppkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Pending'
              ELSE 'Suspended' END AS merchant_status,
         s_acctbal AS balance
  FROM supplier LEFT JOIN places ON n_nationkey = s_nationkey
)"""

_DAMAGED = f"""
bad_customers AS (
  SELECT * REPLACE (
    CASE WHEN balance < 0 THEN 17 ELSE age END AS age,
    CASE WHEN balance >= 9500 THEN 'inf' ELSE CAST(annual_income AS VARCHAR) END
      AS annual_income,
    CASE WHEN balance < 0 AND occupation = 'BUILDING' THEN 'not-a-date'
         ELSE CAST(registration_date AS VARCHAR) END AS registration_date)
  FROM customers
),
bad_cards AS (
  SELECT * REPLACE (
    CASE WHEN card_status = 'Expired' AND card_type = 'Credit' THEN DATE '2026-10-08'
         ELSE issue_date END AS issue_date,
    CASE WHEN card_status = 'Expired' THEN DATE '2026-10-06'
         ELSE expiry_date END AS expiry_date)
  FROM cards WHERE bank_name <> 'Kotak Mahindra Bank'
),
bad_merchants AS (
  SELECT * REPLACE (
    CASE WHEN balance > 9000 THEN 'Unknown' ELSE merchant_category END
      AS merchant_category,
    CASE WHEN balance > 8000 THEN '   ' ELSE merchant_status END AS merchant_status)
  FROM merchants WHERE balance >= 0
),
sent AS ({_described('lines')}
),
bad_transactions AS (
  SELECT * REPLACE (
    CASE WHEN amount > 100000 THEN CAST('inf' AS DOUBLE) WHEN amount < 1000 THEN 0
         ELSE amount END AS amount,
    CASE WHEN payment_method = 'EMV' AND transaction_type = 'Refund' THEN 'not-a-date'
         WHEN payment_method = 'Online' AND transaction_type = 'Refund' THEN '2026-10-08'
         ELSE CAST(transaction_date AS VARCHAR) END AS transaction_date,
    CASE WHEN transaction_status = 'Disputed' THEN 'Unknown'
         ELSE transaction_status END AS transaction_status)
  FROM sent
)"""

_OK = "CASE WHEN is_successful THEN amount END"
_DONE = f"CAST(coalesce(sum({_OK}), 0) AS DOUBLE)"
_SUM = "CAST(coalesce(sum(amount), 0) AS DOUBLE)"
_GOOD_RATE = "avg(CASE WHEN is_successful THEN 1.0e0 ELSE 0.0e0 END)"
_BAD_RATE = "avg(CASE WHEN is_failure THEN 1.0e0 ELSE 0.0e0 END)"
_GOOD = "count(*) FILTER (WHERE is_successful)"
_BAD = "count(*) FILTER (WHERE is_failure)"
_MEAN = "CAST(sum(amount) AS DOUBLE) / CAST(count(amount) AS DOUBLE)"


def _tx(body: str) -> str:
    return f"WITH {_TX}\n{body}"


def _with_dims(body: str) -> str:
    return f"WITH {_TX},{_DIMENSIONS}\n{body}"


def _with_damage(body: str) -> str:
    return f"WITH {_TX},{_DIMENSIONS},{_DAMAGED}\n{body}"


def _measures(dim: str) -> str:
    done = "count(*) FILTER (WHERE transaction_status = 'Completed')"
    failed = "count(*) FILTER (WHERE transaction_status = 'Failed')"
    spent = (
        "CAST(coalesce(sum(CASE WHEN transaction_status = 'Completed' THEN amount END), 0)"
        " AS DOUBLE)"
    )
    return _tx(f"""
SELECT {dim}, {spent} AS completed_amount, count(*) AS transaction_count,
       count(DISTINCT customer_id) AS active_customers,
       {done} AS successful_transactions,
       CAST({done} AS DOUBLE) / count(*) AS success_rate,
       {failed} AS failed_transactions,
       CAST({failed} AS DOUBLE) / count(*) AS failure_rate,
       CASE WHEN {done} = 0 THEN 0 ELSE {spent} / {done} END AS average_completed_ticket
FROM tx GROUP BY {dim}""")


# --- quality --------------------------------------------------------------

_TX_COLUMNS = (
    "transaction_id card_id customer_id merchant_id merchant_name merchant_category "
    "transaction_date amount currency transaction_type transaction_status "
    "payment_method merchant_city merchant_state bank_name card_type customer_city "
    "customer_state description"
).split()
_COLUMNS = {
    "customers": (
        "customer_id first_name last_name gender age email phone city state occupation "
        "annual_income registration_date"
    ).split(),
    "cards": (
        "card_id customer_id card_type bank_name card_network issue_date expiry_date "
        "card_status"
    ).split(),
    "merchants": (
        "merchant_id merchant_name merchant_category city state contact_person email "
        "phone registration_date merchant_status"
    ).split(),
    "transactions": _TX_COLUMNS,
}
_KEYS = {
    "customers": "customer_id",
    "cards": "card_id",
    "merchants": "merchant_id",
    "transactions": "transaction_id",
}
_REFERENCE = "DATE '2026-10-07'"


def _quality(source: dict[str, str], extra: tuple[str, ...] = ()) -> str:
    rows = []

    def count(rule: str, dataset: str, column: str, bad: str) -> None:
        rows.append(
            f"SELECT '{rule}' AS rule, '{dataset}' AS dataset, '{column}' AS \"column\", "
            f"count(*) FILTER (WHERE {bad}) AS violations FROM {source[dataset]}"
        )

    def listed(options) -> str:
        return ", ".join(f"'{option}'" for option in options)

    def parsed(column: str) -> str:
        return f"TRY_CAST(CAST({column} AS VARCHAR) AS DATE)"

    def measured(column: str) -> str:
        return f"TRY_CAST(CAST({column} AS VARCHAR) AS DOUBLE)"

    for dataset, columns in _COLUMNS.items():
        names = [*columns, *extra] if dataset == "transactions" else columns
        for name in names:
            blank = f"trim(CAST({name} AS VARCHAR)) = ''"
            count("V4", dataset, name, f"{name} IS NULL OR {blank}")
        key = _KEYS[dataset]
        count("V5", dataset, key, f"trim({key}) = ''")
        rows.append(
            f"SELECT 'V3', '{dataset}', '{key}', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
            f"(SELECT count(*) AS n FROM {source[dataset]} GROUP BY {key}) k"
        )
    categories = listed(CATEGORIES)
    count("V9", "cards", "card_status",
          "trim(card_status) NOT IN ('Active', 'Blocked', 'Expired')")
    count("V9", "merchants", "merchant_category",
          f"trim(merchant_category) NOT IN ({categories})")
    count("V9", "merchants", "merchant_status",
          "trim(merchant_status) NOT IN ('Active', 'Pending', 'Suspended')")
    count("V9", "transactions", "transaction_status",
          f"trim(transaction_status) NOT IN ({listed(STATUSES)})")
    count("V9", "transactions", "merchant_category",
          f"trim(merchant_category) NOT IN ({categories})")
    dates = {
        "customers": ("registration_date",),
        "cards": ("issue_date", "expiry_date"),
        "merchants": ("registration_date",),
        "transactions": ("transaction_date",),
    }
    for dataset, names in dates.items():
        for name in names:
            count("V10", dataset, name, f"{parsed(name)} IS NULL")
        count("V12", dataset, names[0], f"{parsed(names[0])} > {_REFERENCE}")
    count("V11", "cards", "issue_date", "issue_date >= expiry_date")
    count("V13", "cards", "expiry_date", f"expiry_date <= {_REFERENCE}")
    count("V14", "customers", "annual_income",
          f"NOT coalesce({measured('annual_income')} BETWEEN 300000 AND 3000000, false)")
    count("V15", "customers", "age",
          f"NOT coalesce({measured('age')} BETWEEN 18 AND 100, false)")
    value = measured("amount")
    count("V16", "transactions", "amount",
          f"NOT coalesce({value} > 0 AND isfinite({value}), false)")
    links = (
        ("cards", "customers", "customer_id"),
        ("transactions", "customers", "customer_id"),
        ("transactions", "cards", "card_id"),
        ("transactions", "merchants", "merchant_id"),
    )
    for child, parent, key in links:
        rows.append(
            f"SELECT 'V6', '{child}', '{key}', count(*) FROM {source[child]} c "
            f"WHERE NOT EXISTS (SELECT 1 FROM {source[parent]} p WHERE p.{key} = c.{key})"
        )
    for rule, parent, key, name in (
        ("V7", "cards", "card_id", "customer_id"),
        ("V8", "merchants", "merchant_id", "merchant_category"),
    ):
        rows.append(
            f"SELECT '{rule}', 'transactions', '{name}', "
            f"count(*) FILTER (WHERE NOT coalesce(c.{name} = p.{name}, false)) "
            f"FROM {source['transactions']} c LEFT JOIN {source[parent]} p "
            f"ON p.{key} = c.{key}"
        )
    return "\nUNION ALL ".join(rows)


_CLEAN_SET = {
    "customers": "customers",
    "cards": "cards",
    "merchants": "merchants",
    "transactions": "tx",
}
_BAD_SET = {name: f"bad_{name}" for name in _KEYS}


# --- messages -------------------------------------------------------------

_PREVAILING = (
    "(SELECT currency FROM tx GROUP BY currency ORDER BY count(*) DESC, currency LIMIT 1)"
)
TOPIC_WORDS = {
    "english": ("the", "of the", "and", "in the"),
    "german": ("der", "die", "und", "die und"),
    "french": ("le", "la", "de la", "et"),
    "other": ("para", "que", "el"),
}
TOPIC_PRIORITY = {"english": 1, "german": 3, "french": 2}
VARIANT_RULES = (
    ("english", r"\b(?:with|from)\b", "english_linking"),
    ("english", r"\bthing\w*\b", "english_things"),
    ("german", r"\bein\w*\b", "german_article"),
    ("french", r"\b(?:qui|que)\b", "french_relative"),
)
LISTED_NAMES = ("With the", "Über die", "DE LA", "ththe", "Health & Wellness")
FOLLOW_UP = (r"(?:et|und|and|on|in)\b[^\n]*",)

_EDGE_L = r"(^|[^\p{L}\p{N}_])"
_EDGE_R = r"([^\p{L}\p{N}_]|$)"
_STRIPPED = "trim({0}, E' \\t\\n\\r')"
_FOLDED = "replace(translate(lower(text), 'ſς', 'sσ'), 'ß', 'ss')"


def _found(pattern: str) -> str:
    return f"regexp_matches(folded, '{pattern}')"


def _score(words) -> str:
    return " + ".join(
        f"CASE WHEN {_found(_EDGE_L + word + _EDGE_R)} THEN {len(word.split())} ELSE 0 END"
        for word in words
    )


def _routed(source: str = "conversations", name: str = "") -> str:
    scores = ", ".join(f"{_score(w)} AS s_{t}" for t, w in TOPIC_WORDS.items())
    unions = " UNION ALL ".join(
        f"SELECT conv_id, turn, '{topic}' AS topic, s_{topic} AS score, "
        f"{TOPIC_PRIORITY.get(topic, 0)} AS priority, {i} AS position FROM {name}scored"
        for i, topic in enumerate(TOPIC_WORDS)
    )
    shape = FOLLOW_UP[0].replace(r"\b[^\n]*", r"([^\p{L}\p{N}_\n][^\n]*)?")
    return f"""
{name}folded AS (SELECT *, {_FOLDED} AS folded FROM {source}),
{name}scored AS (SELECT conv_id, turn, {scores} FROM {name}folded),
{name}ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id, turn ORDER BY score DESC, priority DESC, position) AS rn
  FROM ({unions}) candidates WHERE score > 0
),
{name}routed AS (
  SELECT f.conv_id, f.turn, f.role, f.text, f.folded, r.topic,
         regexp_full_match({_STRIPPED.format("f.folded")}, '{shape}') AS is_follow_up
  FROM {name}folded f LEFT JOIN {name}ranked r
    ON r.conv_id = f.conv_id AND r.turn = f.turn AND r.rn = 1
)"""


def _variant() -> str:
    arms = []
    for topic, pattern, label in VARIANT_RULES:
        core = pattern.replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]")
        arms.append(
            f"WHEN topic = '{topic}' AND {_found(_EDGE_L + core + _EDGE_R)} THEN '{label}'"
        )
    return (
        f"CASE WHEN topic IS NULL THEN NULL {' '.join(arms)} ELSE 'general' END"
    )


# DuckDB's word edges know ASCII letters only. Accented letters are masked by an
# ASCII word character first, so edges fall where they should; what is compared
# is masked alike on both sides.
_ACCENTED = "[ªµºÀ-ÖØ-öø-ɏ]"
_REDACTIONS = (
    (
        r"\b(?:my name|name|address|account number|transaction id|"
        r"transaction reference|reference number)\s*(?:is|:|=)\s*[^,;]+",
        "[REDACTED]",
    ),
    (
        r"\b(?:cvv|cvc|security code|pin|otp|password|one[- ]time password)\b"
        r"\s*(?:is|:|=)?\s*[A-Za-z0-9-]+",
        "[REDACTED]",
    ),
    (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED EMAIL]"),
    (r"\b(?:\d[ -]?){11,18}\d\b", "[REDACTED NUMBER]"),
    (r"\b(?:\+?\d[ ().-]*){10,15}\b", "[REDACTED PHONE]"),
)
_ASKING = (
    r"\b(?:share|send|provide|enter|tell me|give me|confirm)\s+(?:your\s+)?"
    r"(?:card number|card details|cvv|cvc|pin|otp|password)\b"
)


def _redacted(expression: str) -> str:
    for pattern, marker in _REDACTIONS:
        expression = f"regexp_replace({expression}, '(?i){pattern}', '{marker}', 'g')"
    return expression


def _repeats(table: str, group: str, order: str, where: str = "") -> str:
    """CTE repeats: whether the redacted text was said before, as it was written then."""
    return f"""
spoken AS (
  SELECT {group}, {order}, {_FOLDED} AS folded,
         {_FOLDED.replace("(text)", f"({_redacted(_STRIPPED.format('text'))})")} AS asked
  FROM {table} {where}
), firsts AS (
  SELECT {group}, folded, min({order}) AS first_at FROM spoken GROUP BY {group}, folded
), repeats AS (
  SELECT s.{group}, s.{order}, coalesce(f.first_at < s.{order}, FALSE) AS is_repeat
  FROM spoken s LEFT JOIN firsts f ON f.{group} = s.{group} AND f.folded = s.asked
)"""


_MASKED = f"""
masked AS (
  SELECT doc_id, regexp_replace(text, '{_ACCENTED}', '_', 'g') AS plain FROM documents
),
safe AS (SELECT doc_id, plain, {_redacted('plain')} AS text FROM masked)"""


def _markers(name: str) -> str:
    return f"len(regexp_extract_all(text, '\\[{name}\\]'))"


_NAME_FORM = r"trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}_%]+', ' ', 'g'))"


def _form(expression: str) -> str:
    folded = f"replace(translate(lower({expression}), 'ſς', 'sσ'), 'ß', 'ss')"
    return _NAME_FORM.format(folded)


# --- the statements -------------------------------------------------------

_MERCHANT = "merchant_id, merchant_name, merchant_category"
_SNAP_MERCHANTS = f"""
SELECT merchant_name AS merchant, merchant_category AS category,
       count(*) AS transaction_count, {_BAD_RATE} AS failure_rate,
       {_DONE} AS completed_amount, {_BAD} AS failed_transactions
FROM tx GROUP BY merchant_name, merchant_category"""
_SNAP_BANKS = f"""
SELECT bank_name AS bank, count(*) AS transaction_count,
       {_GOOD} AS completed_transactions, {_DONE} AS completed_amount,
       {_GOOD_RATE} AS success_rate,
       count(*) FILTER (WHERE lower(transaction_status) = 'failed') AS failed_transactions
FROM tx GROUP BY bank_name"""
_SNAP_CATEGORIES = f"""
SELECT merchant_category AS category, count(*) AS transaction_count,
       {_DONE} AS completed_amount, {_BAD} AS failed_transactions,
       {_BAD_RATE} AS failure_rate
FROM tx GROUP BY merchant_category"""


def _best(source: str, entity: str, metrics: dict[str, str], then: str = "") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, {entity}{then}, CAST({metric} AS DOUBLE) AS value, "
        f"{tie} AS tie FROM entities"
        for metric, tie in metrics.items()
    )
    return _tx(f"""
, entities AS ({source})
SELECT metric, {entity}, value FROM (
  SELECT *, row_number() OVER (
    PARTITION BY metric ORDER BY value DESC, tie DESC, {entity} DESC{then}) AS rn
  FROM ({rows}) r
) x WHERE rn = 1""")


_CHOSEN = (
    "merchant_category IN ('Travel', 'Grocery', 'Retail') "
    "AND bank_name IN ('HDFC Bank', 'Axis Bank')"
)


# --- synthetic tables -------------------------------------------------------

_PLACES = (
    ("Hyderabad", "Telangana"), ("Bengaluru", "Karnataka"), ("Mumbai", "Maharashtra"),
    ("Chennai", "Tamil Nadu"), ("Delhi", "Delhi"), ("Pune", "Maharashtra"),
    ("Kolkata", "West Bengal"), ("Ahmedabad", "Gujarat"), ("Jaipur", "Rajasthan"),
    ("Lucknow", "Uttar Pradesh"),
)
_OCCUPATIONS = (
    "Software Engineer", "Doctor", "Teacher", "Data Analyst", "Bank Manager", "Student",
    "Business Owner", "Accountant", "Civil Engineer", "Marketing Executive",
)


def _draw(seed: int, what: str, *keys: str) -> str:
    key = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    digest = f"md5('{seed}:{what}:' || {key})"
    return f"(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def _between(draw: str, low: int, high: int) -> str:
    return f"CAST(floor({draw} * {high - low + 1}) + {low} AS INTEGER)"


def _choice(draw: str, options) -> str:
    listed = ", ".join(f"'{option}'" for option in options)
    return f"([{listed}])[{_between(draw, 1, len(options))}]"


def _weighted(draw: str, weights: dict[str, int]) -> str:
    arms, reached = [], 0.0
    names = list(weights)
    for name in names[:-1]:
        reached += weights[name] / sum(weights.values())
        arms.append(f"WHEN {draw} < CAST('{reached!r}' AS DOUBLE) THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{names[-1]}' END"


def _digits(draw: str) -> str:
    return f"lpad(CAST(CAST(floor({draw} * 10000000000) AS BIGINT) AS VARCHAR), 10, '0')"


_CITIES, _STATES = zip(*_PLACES, strict=True)
_STATUS = {"Completed": 72, "Pending": 12, "Failed": 8, "Refunded": 6, "Disputed": 2}
_LEISURE_STATUS = {"Completed": 68, "Pending": 14, "Failed": 10, "Refunded": 6, "Disputed": 2}
_KINDS = {"Purchase": 70, "Refund": 12, "Bill Payment": 8, "Wallet Top-up": 5, "Merchant Payment": 5}


def _spent(low: int, high: int) -> str:
    return f"CAST({low} + {_draw(45, 'amount', 'card_id', 'nth')} * {high - low} AS DECIMAL(12, 2))"


_SYNTHETIC = f"""
made_customers AS (
  SELECT id, {_padded('C', 'id', 6)} AS customer_id, 'Given' || CAST(id AS VARCHAR) AS first_name,
         'Family' || CAST(id AS VARCHAR) AS last_name,
         {_choice(_draw(42, 'gender', 'id'), ('Male', 'Female'))} AS gender,
         {_between(_draw(42, 'age', 'id'), 18, 70)} AS age,
         'customer' || CAST(id AS VARCHAR) || '@example.com' AS email,
         {_digits(_draw(42, 'phone', 'id'))} AS phone,
         {_choice(_draw(42, 'place', 'id'), _CITIES)} AS city,
         {_choice(_draw(42, 'place', 'id'), _STATES)} AS state,
         {_choice(_draw(42, 'occupation', 'id'), _OCCUPATIONS)} AS occupation,
         {_between(_draw(42, 'income', 'id'), 300000, 3000000)} AS annual_income,
         {_REFERENCE} - {_between(_draw(42, 'since', 'id'), 0, 1095)} AS registration_date
  FROM (SELECT c_custkey + 1 AS id FROM customer)
),
made_merchants AS (
  SELECT {_padded('M', 'id', 6)} AS merchant_id, 'Merchant ' || CAST(id AS VARCHAR) AS merchant_name,
         {_choice(_draw(44, 'category', 'id'), CATEGORIES)} AS merchant_category,
         {_choice(_draw(44, 'place', 'id'), _CITIES)} AS city,
         {_choice(_draw(44, 'place', 'id'), _STATES)} AS state,
         'Contact ' || CAST(id AS VARCHAR) AS contact_person,
         'merchant' || CAST(id AS VARCHAR) || '@example.com' AS email,
         {_digits(_draw(44, 'phone', 'id'))} AS phone,
         {_REFERENCE} - {_between(_draw(44, 'since', 'id'), 0, 1825)} AS registration_date,
         {_choice(_draw(44, 'status', 'id'), ('Active', 'Pending', 'Suspended'))} AS merchant_status
  FROM (SELECT s_suppkey + 1 AS id FROM supplier)
),
held AS (
  SELECT id, customer_id, city, state, nth, (id - 1) * 3 + nth AS number
  FROM made_customers, unnest(range(1, {_between(_draw(43, 'cards', 'customer_id'), 1, 3)} + 1)) AS n(nth)
),
made_cards AS (
  SELECT number, city, state, {_padded('CARD', 'number', 6)} AS card_id, customer_id,
         {_choice(_draw(43, 'type', 'customer_id', 'nth'), ('Debit', 'Credit'))} AS card_type,
         {_choice(_draw(43, 'bank', 'customer_id', 'nth'), BANKS)} AS bank_name, 'Visa' AS card_network,
         {_REFERENCE} - {_between(_draw(43, 'issue', 'customer_id', 'nth'), 0, 1095)} AS issue_date,
         {_REFERENCE} + {_between(_draw(43, 'expiry', 'customer_id', 'nth'), 365, 2190)} AS expiry_date,
         {_choice(_draw(43, 'status', 'customer_id', 'nth'), ('Active', 'Blocked', 'Expired'))} AS card_status
  FROM held
),
used AS (
  SELECT *, CASE card_status WHEN 'Blocked' THEN {_between(_draw(45, 'uses', 'card_id'), 0, 4)}
                 WHEN 'Expired' THEN {_between(_draw(45, 'uses', 'card_id'), 0, 2)}
                 ELSE {_between(_draw(45, 'uses', 'card_id'), 4, 18)} END AS uses
  FROM made_cards
),
shops AS (
  SELECT *, row_number() OVER (ORDER BY merchant_id) - 1 AS place FROM made_merchants
),
visits AS (
  SELECT u.number * 18 - 18 + n.nth AS tx_number, u.card_id, u.customer_id, n.nth, u.bank_name, u.card_type,
         u.city AS customer_city, u.state AS customer_state,
         CAST(floor({_draw(45, 'merchant', 'u.card_id', 'n.nth')} * (SELECT count(*) FROM shops)) AS BIGINT) AS place
  FROM used u, unnest(range(1, u.uses + 1)) AS n(nth)
),
drawn AS (
  SELECT v.*, s.merchant_id, s.merchant_name, s.merchant_category, s.city AS merchant_city,
         s.state AS merchant_state,
         CASE WHEN merchant_category IN ('Travel', 'Entertainment')
              THEN {_weighted(_draw(45, 'status', 'card_id', 'nth'), _LEISURE_STATUS)}
              ELSE {_weighted(_draw(45, 'status', 'card_id', 'nth'), _STATUS)} END AS transaction_status,
         {_weighted(_draw(45, 'type', 'card_id', 'nth'), _KINDS)} AS transaction_type,
         CASE WHEN merchant_category IN ('Grocery', 'Restaurants', 'Retail') THEN {_spent(80, 3500)}
              WHEN merchant_category IN ('Education', 'Online Services', 'Health & Wellness') THEN {_spent(200, 6000)}
              ELSE {_spent(300, 10000)} END AS spent
  FROM visits v JOIN shops s USING (place)
),
made_transactions AS (
  SELECT {_padded('TXN', 'tx_number', 9)} AS transaction_id, card_id, customer_id, merchant_id,
         merchant_name, merchant_category,
         {_REFERENCE} - {_between(_draw(45, 'day', 'card_id', 'nth'), 0, 540)} AS transaction_date,
         CAST(CASE WHEN transaction_type = 'Refund' AND transaction_status = 'Completed'
              THEN CAST(CAST(spent AS DOUBLE) * (CAST('0.1' AS DOUBLE)
                + {_draw(45, 'refund', 'card_id', 'nth')} * CAST('{0.6 - 0.1!r}' AS DOUBLE)) AS DECIMAL(12, 2))
              ELSE spent END AS DOUBLE) AS amount,
         'INR' AS currency, transaction_type, transaction_status,
         CASE WHEN card_type = 'Credit'
              THEN {_choice(_draw(45, 'method', 'card_id', 'nth'), ('Chip', 'Contactless', 'Online', 'EMV'))}
              ELSE {_choice(_draw(45, 'method', 'card_id', 'nth'), ('Chip', 'Contactless', 'Online', 'ATM'))}
              END AS payment_method,
         merchant_city, merchant_state, bank_name, card_type, customer_city, customer_state,
         'Synthetic payment ' || CAST(nth AS VARCHAR) AS description
  FROM drawn
)"""


def _made(table: str, hidden: str = "") -> str:
    return f"WITH {_SYNTHETIC.lstrip()}\nSELECT * {hidden} FROM made_{table}"


_ALL_GRAINS = f"""
SELECT 'overall' AS grain, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS category,
       count(*) AS transaction_count, {_GOOD} AS completed_transactions,
       {_DONE} AS completed_amount, {_GOOD_RATE} AS success_rate,
       {_BAD} AS failed_transactions, -1.0e0 AS failure_rate FROM tx
UNION ALL SELECT 'bank', bank_name, NULL, count(*), {_GOOD}, {_DONE}, {_GOOD_RATE},
       {_BAD}, -1.0e0 FROM tx GROUP BY bank_name
UNION ALL SELECT 'month', transaction_month, NULL, count(*), {_GOOD}, {_DONE}, -1.0e0,
       {_BAD}, -1.0e0 FROM tx GROUP BY transaction_month
UNION ALL SELECT 'merchant', merchant_name, merchant_category, count(*), -1, {_DONE},
       -1.0e0, {_BAD}, {_BAD_RATE} FROM tx GROUP BY merchant_name, merchant_category
UNION ALL SELECT 'category', merchant_category, NULL, count(*), -1, {_DONE}, -1.0e0,
       {_BAD}, {_BAD_RATE} FROM tx GROUP BY merchant_category"""

ORACLES: dict[str, str] = {
    # summaries and reports
    "customer_summary": _tx(f"""
SELECT customer_id, count(transaction_id) AS successful_transactions,
       {_SUM} AS successful_spend, {_MEAN} AS average_transaction_value
FROM tx WHERE is_successful AND customer_id IS NOT NULL GROUP BY customer_id"""),
    "merchant_summary": _tx(f"""
SELECT {_MERCHANT}, count(transaction_id) AS transaction_count,
       {_SUM} AS total_amount, {_DONE} AS completed_amount,
       {_BAD} AS failed_transactions
FROM tx GROUP BY {_MERCHANT}"""),
    "monthly_performance": _tx(f"""
SELECT transaction_month, count(transaction_id) AS transaction_count,
       {_DONE} AS completed_amount, {_BAD_RATE} AS failure_rate
FROM tx WHERE transaction_month IS NOT NULL GROUP BY transaction_month"""),
    "category_performance": _tx(f"""
SELECT merchant_category, count(transaction_id) AS transaction_count,
       {_SUM} AS total_amount, {_DONE} AS completed_amount,
       {_BAD_RATE} AS failure_rate
FROM tx WHERE merchant_category IS NOT NULL GROUP BY merchant_category"""),
    "status_distribution": _tx("""
SELECT transaction_status AS status, count(*) AS transaction_count
FROM tx WHERE transaction_status IS NOT NULL GROUP BY transaction_status"""),
    "report_rollup": _tx("""
SELECT CASE WHEN grouping(customer_id) = 0 THEN 'customer'
            WHEN grouping(merchant_id) = 0 THEN 'merchant'
            WHEN grouping(transaction_month) = 0 THEN 'month'
            WHEN grouping(merchant_category) = 0 THEN 'category'
            WHEN grouping(transaction_status) = 0 THEN 'status'
            ELSE 'overall' END AS grain,
       customer_id, merchant_id, merchant_name, merchant_category, transaction_month,
       transaction_status, count(*) AS row_count, count(transaction_id) AS id_count,
       CAST(sum(amount) AS DOUBLE) AS amount,
       CAST(sum(CAST(amount * amount AS DECIMAL(30, 4))) AS DOUBLE) AS squares,
       count(*) FILTER (WHERE is_successful) AS done_rows,
       count(transaction_id) FILTER (WHERE is_successful) AS done_ids,
       CAST(coalesce(sum(amount) FILTER (WHERE is_successful), 0) AS DOUBLE)
         AS done_amount,
       count(*) FILTER (WHERE is_failure) AS failed
FROM tx GROUP BY GROUPING SETS ((customer_id),
  (merchant_id, merchant_name, merchant_category), (transaction_month),
  (merchant_category), (transaction_status), ())"""),
    # business queries
    "kpi": _tx(f"""
SELECT {_DONE} AS completed_amount, count(*) AS total_transactions,
       count(DISTINCT customer_id) AS active_customers,
       round(100 * {_GOOD_RATE}, 2) AS success_rate_pct
FROM tx"""),
    "monthly_trend": _tx(f"""
SELECT transaction_month, count(*) AS transaction_count, {_DONE} AS completed_amount
FROM tx GROUP BY transaction_month"""),
    "category_kpi": _tx(f"""
SELECT merchant_category, count(*) AS transaction_count, {_DONE} AS completed_amount,
       round(100 * {_BAD_RATE}, 2) AS failure_rate_pct
FROM tx GROUP BY merchant_category"""),
    "top_customers": _tx(f"""
SELECT customer_id, count(*) AS completed_transactions, {_SUM} AS completed_spend,
       {_MEAN} AS average_ticket
FROM tx WHERE is_successful GROUP BY customer_id
ORDER BY completed_spend DESC, customer_id LIMIT 10"""),
    "merchant_risk": _tx(f"""
SELECT {_MERCHANT}, count(*) AS transaction_count,
       round(100 * {_BAD_RATE}, 2) AS failure_rate_pct
FROM tx GROUP BY {_MERCHANT}
HAVING count(*) >= 5 AND {_BAD_RATE} > (SELECT {_BAD_RATE} FROM tx)"""),
    "bank_card_mix": _tx(f"""
SELECT bank_name, card_type, count(*) AS transaction_count,
       {_DONE} AS completed_amount, round(100 * {_GOOD_RATE}, 2) AS success_rate_pct
FROM tx GROUP BY bank_name, card_type"""),
    # listing service
    "service_summary": _tx(f"""
SELECT count(*) AS total_transactions, {_GOOD} AS completed_transactions,
       {_DONE} AS completed_amount,
       CAST({_GOOD} AS DOUBLE) / count(*) AS success_rate,
       count(DISTINCT customer_id) AS active_customers,
       (SELECT currency FROM tx GROUP BY currency
        ORDER BY count(*) DESC, currency LIMIT 1) AS currency
FROM tx"""),
    "service_categories": _tx(f"""
SELECT merchant_category AS category, count(*) AS transaction_count,
       {_DONE} AS completed_amount
FROM tx WHERE merchant_category IS NOT NULL GROUP BY merchant_category"""),
    "service_banks": _tx(f"""
SELECT bank_name, count(*) AS transaction_count, {_GOOD} AS completed_transactions,
       {_DONE} AS completed_amount
FROM tx WHERE bank_name IS NOT NULL GROUP BY bank_name"""),
    "service_merchants": _tx(f"""
SELECT {_MERCHANT}, count(*) AS transaction_count, {_BAD_RATE} AS failure_rate,
       {_DONE} AS completed_amount
FROM tx GROUP BY {_MERCHANT}
ORDER BY completed_amount DESC, {_MERCHANT} LIMIT 20"""),
    "transaction_page": _tx("""
, wanted AS (
  SELECT * FROM tx WHERE lower(merchant_category) = 'health & wellness'
    AND lower(transaction_status) = 'completed' AND lower(bank_name) = 'axis bank'
)
SELECT (SELECT count(*) FROM wanted) AS total, 50 AS "limit", 100 AS "offset",
       transaction_id, merchant_id, merchant_name, merchant_category,
       transaction_date, CAST(amount AS DOUBLE) AS amount, currency, transaction_type,
       transaction_status, payment_method, merchant_city, merchant_state, bank_name,
       card_type
FROM wanted ORDER BY transaction_id LIMIT 50 OFFSET 100"""),
    "transaction_deep_page": _tx("""
, wanted AS (
  SELECT * FROM tx
)
SELECT (SELECT count(*) FROM wanted) AS total, 100 AS "limit", 20000 AS "offset",
       transaction_id, merchant_id, merchant_name, merchant_category,
       transaction_date, CAST(amount AS DOUBLE) AS amount, currency, transaction_type,
       transaction_status, payment_method, merchant_city, merchant_state, bank_name,
       card_type
FROM wanted ORDER BY transaction_id LIMIT 100 OFFSET 20000"""),
    "frequent_method": _tx("""
SELECT payment_method FROM tx GROUP BY payment_method
ORDER BY count(*) DESC, payment_method LIMIT 1"""),
    # dashboard
    "dashboard_kpi": _tx(f"""
SELECT {_DONE} AS completed_amount, count(*) AS transactions,
       count(DISTINCT customer_id) AS active_customers,
       coalesce({_GOOD_RATE}, 0) AS success_rate
FROM tx WHERE {_CHOSEN}"""),
    "dashboard_monthly": _tx(f"""
SELECT strftime(transaction_date, '%Y-%m') AS transaction_month,
       {_DONE} AS completed_amount, count(transaction_id) AS transactions
FROM tx WHERE {_CHOSEN} GROUP BY 1"""),
    "dashboard_categories": _tx(f"""
SELECT merchant_category, {_SUM} AS completed_amount
FROM tx WHERE is_successful AND {_CHOSEN} GROUP BY merchant_category"""),
    "dashboard_statuses": _tx(f"""
SELECT transaction_status AS status, count(*) AS transaction_count
FROM tx WHERE {_CHOSEN} GROUP BY transaction_status"""),
    "bank_card_pivot": _tx("""
SELECT bank_name,
       CAST(coalesce(sum(CASE WHEN card_type = 'Credit' THEN amount END), 0) AS DOUBLE)
         AS "Credit",
       CAST(coalesce(sum(CASE WHEN card_type = 'Debit' THEN amount END), 0) AS DOUBLE)
         AS "Debit"
FROM tx WHERE is_successful GROUP BY bank_name"""),
    "dashboard_customers": _tx(f"""
SELECT customer_id, {_SUM} AS completed_spend, count(transaction_id) AS transactions
FROM tx WHERE is_successful AND {_CHOSEN} GROUP BY customer_id
ORDER BY completed_spend DESC, customer_id LIMIT 10"""),
    "dashboard_failing_merchants": _tx(f"""
SELECT {_MERCHANT}, count(transaction_id) AS transactions,
       {_BAD_RATE} AS failure_rate, {_SUM} AS total_amount
FROM tx WHERE {_CHOSEN} GROUP BY {_MERCHANT} HAVING count(transaction_id) >= 5
ORDER BY failure_rate DESC, {_MERCHANT} LIMIT 10"""),
    "latest_transactions": _tx(f"""
SELECT transaction_id, merchant_name, merchant_category, transaction_date,
       CAST(amount AS DOUBLE) AS amount, transaction_status, payment_method,
       merchant_city, merchant_state, bank_name, card_type
FROM tx WHERE {_CHOSEN}"""),
    # snapshot
    "snapshot_overall": _tx(f"""
SELECT count(*) AS total_transactions, {_GOOD} AS completed_transactions,
       {_DONE} AS completed_amount,
       CAST({_GOOD} AS DOUBLE) / count(*) AS success_rate,
       (SELECT currency FROM tx GROUP BY currency
        ORDER BY count(*) DESC, currency LIMIT 1) AS currency,
       count(*) FILTER (WHERE lower(transaction_status) = 'failed')
         AS failed_transactions
FROM tx"""),
    "snapshot_banks": _tx(_SNAP_BANKS),
    "snapshot_merchants": _tx(_SNAP_MERCHANTS),
    "snapshot_categories": _tx(_SNAP_CATEGORIES),
    "snapshot_months": _tx(f"""
SELECT transaction_month AS month, count(*) AS transaction_count,
       {_GOOD} AS completed_transactions,
       count(*) FILTER (WHERE lower(transaction_status) = 'failed')
         AS failed_transactions,
       {_DONE} AS completed_amount
FROM tx GROUP BY transaction_month"""),
    "snapshot_all_grains": _tx(_ALL_GRAINS),
    "snapshot_of_texts": _tx(_ALL_GRAINS),
    "damaged_snapshot_gate": _tx("""
SELECT 'amount' AS "column",
       count(*) FILTER (WHERE merchant_category IN ('Grocery', 'Travel')) AS violations FROM tx
UNION ALL SELECT 'transaction_status',
       count(*) FILTER (WHERE transaction_status IN ('Disputed', 'Refunded')) FROM tx
UNION ALL SELECT 'transaction_month', count(*) FILTER (WHERE merchant_category = 'Retail') FROM tx
UNION ALL SELECT 'is_successful', count(*) FILTER (WHERE transaction_status = 'Pending') FROM tx
UNION ALL SELECT 'is_failure', count(*) FILTER (WHERE is_failure) FROM tx"""),
    "snapshot_gate": _tx(r"""
SELECT 'amount' AS "column",
       count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) AS violations FROM tx
UNION ALL SELECT 'transaction_status',
       count(*) FILTER (WHERE NOT coalesce(trim(transaction_status) <> '', false)) FROM tx
UNION ALL SELECT 'transaction_month',
       count(*) FILTER (WHERE NOT coalesce(
         regexp_full_match(transaction_month, '\d{4}-\d{2}'), false)) FROM tx"""),
    # document-style
    "document_monthly": _tx(f"""
SELECT transaction_month, {_SUM} AS completed_amount, count(*) AS transaction_count
FROM tx WHERE transaction_status = 'Completed' GROUP BY transaction_month"""),
    "document_categories": _tx(f"""
SELECT merchant_category, count(*) AS transactions,
       CAST(sum(CASE WHEN transaction_status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       {_SUM} AS amount
FROM tx GROUP BY merchant_category"""),
    "document_customers": _tx(f"""
SELECT customer_id, {_SUM} AS completed_spend, count(*) AS transactions,
       array_to_string(list_sort(list(DISTINCT merchant_category)), ',') AS categories
FROM tx WHERE transaction_status = 'Completed' GROUP BY customer_id
ORDER BY completed_spend DESC, customer_id LIMIT 10"""),
    # measures
    "measures_by_bank": _measures("bank_name"),
    "measures_by_method": _measures("payment_method"),
    "measures_by_state": _measures("customer_state"),
    "measures_by_status": _measures("transaction_status"),
    "measures_overall": _measures("'all'").replace("SELECT 'all',", "SELECT", 1).replace(
        "GROUP BY 'all'", ""
    ),
    # comparison and ranking
    "compare_banks": _tx(f"""
, banks AS ({_SNAP_BANKS})
SELECT *, CAST(failed_transactions AS DOUBLE) / transaction_count AS failure_rate,
       {_PREVAILING} AS currency
FROM banks"""),
    "compare_merchants": _tx(f"""
, merchants AS ({_SNAP_MERCHANTS})
SELECT *, {_PREVAILING} AS currency FROM merchants"""),
    "compare_categories": _tx(f"""
, categories AS ({_SNAP_CATEGORIES})
SELECT *, {_PREVAILING} AS currency FROM categories
WHERE category IN ('Travel', 'Grocery')"""),
    "bank_failures": _tx(f"""
, banks AS ({_SNAP_BANKS})
SELECT bank, failed_transactions, transaction_count,
       CAST(failed_transactions AS DOUBLE) / transaction_count AS failure_rate
FROM banks WHERE bank = 'Axis Bank'"""),
    "merchant_failures": _tx(f"""
, merchants AS ({_SNAP_MERCHANTS})
SELECT merchant, category, failed_transactions, transaction_count,
       CAST(failed_transactions AS DOUBLE) / transaction_count AS failure_rate
FROM merchants"""),
    "category_failures": _tx(f"""
, categories AS ({_SNAP_CATEGORIES})
SELECT category, failed_transactions, transaction_count,
       CAST(failed_transactions AS DOUBLE) / transaction_count AS failure_rate
FROM categories"""),
    "overall_failures": _tx(f"""
SELECT {_BAD} AS failed_transactions, count(*) AS total_transactions,
       CAST({_BAD} AS DOUBLE) / count(*) AS failure_rate
FROM tx"""),
    "top_bank_by_metric": _best(
        _SNAP_BANKS,
        "bank",
        {
            "transaction_count": "transaction_count",
            "completed_amount": "transaction_count",
            "completed_transactions": "transaction_count",
            "success_rate": "transaction_count",
            "failed_transactions": "0",
        },
    ),
    "top_merchant_by_metric": _best(
        _SNAP_MERCHANTS,
        "merchant",
        {
            "transaction_count": "0",
            "completed_amount": "0",
            "failed_transactions": "0",
            "failure_rate": "0",
        },
        ", category",
    ),
    "top_category_by_metric": _best(
        _SNAP_CATEGORIES,
        "category",
        {
            "transaction_count": "0",
            "completed_amount": "0",
            "failed_transactions": "0",
            "failure_rate": "0",
        },
    ),
    "busiest_merchants": _tx(
        _SNAP_MERCHANTS
        + "\nORDER BY transaction_count DESC, merchant, category LIMIT 10"
    ),
    "bank_series": _tx(f"""
, banks AS ({_SNAP_BANKS}) SELECT bank, success_rate FROM banks"""),
    "month_series": _tx(f"""
SELECT transaction_month AS month, count(*) AS transaction_count,
       {_GOOD} AS completed_transactions, {_BAD} AS failed_transactions
FROM tx GROUP BY transaction_month"""),
    # anomalies
    "amount_anomalies": _tx("""
, stats AS (
  SELECT avg(CAST(amount AS DOUBLE)) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS s FROM tx
)
SELECT transaction_id, CAST(amount AS DOUBLE) AS amount,
       round((CAST(amount AS DOUBLE) - m) / s, 6) AS amount_z_score,
       true AS amount_anomaly
FROM tx, stats WHERE abs((CAST(amount AS DOUBLE) - m) / s) >= 1.7"""),
    "event_value_anomalies": """
WITH stats AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id, user_id, event_type, value, round((value - m) / s, 6) AS amount_z_score,
       true AS amount_anomaly
FROM events, stats WHERE abs((value - m) / s) >= 3""",
    "amount_spread": _tx("""
SELECT round(avg(CAST(amount AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST(amount AS DOUBLE)), 6) AS std FROM tx"""),
    # quality
    "quality_of_clean_tables": _with_dims(
        _quality(_CLEAN_SET, ("transaction_month", "is_successful", "is_failure"))
    ),
    "quality_of_damaged_tables": _with_damage(
        f"SELECT * FROM ({_quality(_BAD_SET)}) q WHERE violations > 0"
    ),
    "damaged_invalid_values": _with_damage(f"""
SELECT * FROM (
  SELECT 'cards' AS dataset, 'card_status' AS "column", trim(card_status) AS value,
         count(*) AS row_count FROM bad_cards
  WHERE trim(card_status) NOT IN ('Active', 'Blocked', 'Expired') GROUP BY 3
  UNION ALL
  SELECT 'merchants', 'merchant_category', trim(merchant_category), count(*)
  FROM bad_merchants WHERE trim(merchant_category) NOT IN
    ({", ".join(f"'{c}'" for c in CATEGORIES)}) GROUP BY 3
  UNION ALL
  SELECT 'merchants', 'merchant_status', trim(merchant_status), count(*)
  FROM bad_merchants
  WHERE trim(merchant_status) NOT IN ('Active', 'Pending', 'Suspended') GROUP BY 3
  UNION ALL
  SELECT 'transactions', 'transaction_status', trim(transaction_status), count(*)
  FROM bad_transactions WHERE trim(transaction_status) NOT IN
    ({", ".join(f"'{s}'" for s in STATUSES)}) GROUP BY 3
) v"""),
    "duplicate_transaction_ids": _with_damage("""
SELECT transaction_id, count(*) AS n FROM bad_transactions
GROUP BY transaction_id HAVING count(*) > 1"""),
    "orphan_transactions": _with_damage("""
SELECT t.transaction_id, t.merchant_id FROM bad_transactions t
WHERE NOT EXISTS (SELECT 1 FROM bad_merchants m WHERE m.merchant_id = t.merchant_id)"""),
    "sql_quality_checks": _with_damage("""
SELECT 'invalid_transaction_card_links' AS "check", count(*) AS violations
FROM bad_transactions t LEFT JOIN bad_cards c ON c.card_id = t.card_id
WHERE c.card_id IS NULL
UNION ALL
SELECT 'invalid_transaction_customer_links', count(*)
FROM bad_transactions t LEFT JOIN bad_customers c ON c.customer_id = t.customer_id
WHERE c.customer_id IS NULL
UNION ALL
SELECT 'transaction_card_customer_mismatches', count(*)
FROM bad_transactions t JOIN bad_cards c ON c.card_id = t.card_id
WHERE c.customer_id <> t.customer_id
UNION ALL
SELECT 'invalid_transaction_merchant_links', count(*)
FROM bad_transactions t LEFT JOIN bad_merchants m ON m.merchant_id = t.merchant_id
WHERE m.merchant_id IS NULL"""),
    "card_preconditions": _with_damage(f"""
SELECT 'null_customer_id' AS "check",
       count(*) FILTER (WHERE customer_id IS NULL) AS violations FROM bad_customers
UNION ALL SELECT 'duplicate_customer_id', count(*) - count(DISTINCT customer_id)
FROM bad_customers
UNION ALL SELECT 'duplicate_card_id', count(*) - count(DISTINCT card_id) FROM bad_cards
UNION ALL SELECT 'no_cards', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM bad_cards
UNION ALL SELECT 'null_customer', count(*) FILTER (WHERE customer_id IS NULL)
FROM bad_cards
UNION ALL SELECT 'null_issue', count(*) FILTER (WHERE issue_date IS NULL) FROM bad_cards
UNION ALL SELECT 'null_expiry', count(*) FILTER (WHERE expiry_date IS NULL)
FROM bad_cards
UNION ALL SELECT 'issue_not_before_expiry',
       count(*) FILTER (WHERE issue_date >= expiry_date) FROM bad_cards
UNION ALL SELECT 'issue_in_future',
       count(*) FILTER (WHERE issue_date > {_REFERENCE}) FROM bad_cards
UNION ALL SELECT 'expiry_not_after_reference',
       count(*) FILTER (WHERE expiry_date <= {_REFERENCE}) FROM bad_cards"""),
    "row_counts": _with_dims("""
SELECT 'customers' AS table_name, count(*) AS row_count FROM customers
UNION ALL SELECT 'cards_public', count(*) FROM cards
UNION ALL SELECT 'merchants', count(*) FROM merchants
UNION ALL SELECT 'transactions_clean', count(*) FROM tx"""),
    # fact and dimensions
    "clean_transactions": _tx(
        "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM tx"
    ),
    "first_copies": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS rn
  FROM lineitem
) r WHERE rn = 1""",
    "star_join": _with_dims("""
SELECT t.transaction_id, t.customer_id, t.card_id, t.merchant_id,
       CAST(t.amount AS DOUBLE) AS amount, c.gender, c.age, c.occupation,
       k.card_network, k.card_status, m.merchant_status
FROM tx t LEFT JOIN customers c ON c.customer_id = t.customer_id
LEFT JOIN cards k ON k.card_id = t.card_id
LEFT JOIN merchants m ON m.merchant_id = t.merchant_id"""),
    "public_cards": _with_dims("SELECT * FROM cards"),
    "merchants_without_contacts": _with_dims(
        "SELECT * EXCLUDE (contact_person, email, phone, balance) FROM merchants"
    ),
    "owned_cards": _with_dims("""
SELECT k.card_id, k.customer_id, c.city AS customer_city, c.state AS customer_state
FROM cards k JOIN customers c ON c.customer_id = k.customer_id"""),
    # messages
    "valid_messages": """
SELECT conv_id, turn, role, trim(text, E' \\t\\n\\r') AS text FROM conversations
WHERE length(trim(text, E' \\t\\n\\r')) BETWEEN 1 AND 500""",
    "routed_messages": f"""
WITH {_routed()}
SELECT conv_id, turn, topic FROM routed""",
    "carried_topics": f"""
WITH {_routed()}, carried AS (
  SELECT conv_id, turn, role, topic, is_follow_up,
         last_value(CASE WHEN role = 'user' THEN topic END IGNORE NULLS) OVER (
           PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS said
  FROM routed
)
SELECT conv_id, turn, topic, is_follow_up,
       coalesce(topic, CASE WHEN is_follow_up THEN said END) AS resolved_topic
FROM carried WHERE role = 'user'""",
    "answer_variants": f"""
WITH {_routed()}
SELECT conv_id, turn, topic, {_variant()} AS variant FROM routed""",
    "entity_mentions": f"""
WITH names AS (
  SELECT DISTINCT 'site' AS kind, regexp_extract(url, '^https?://([^./]+)', 1) AS name
  FROM pages
)
SELECT c.conv_id, c.turn, n.kind, n.name
FROM conversations c JOIN names n
  ON {_form('n.name')} <> '' AND contains({_form('c.text')}, {_form('n.name')})""",
    "redaction_profile": f"""
WITH {_MASKED}
SELECT doc_id, {_markers('REDACTED')} AS "values", {_markers('REDACTED EMAIL')} AS emails,
       {_markers('REDACTED NUMBER')} AS numbers, {_markers('REDACTED PHONE')} AS phones,
       length(text) AS chars, md5(text) AS digest
FROM safe""",
    "unsafe_texts": f"""
WITH {_MASKED}, flags AS (
  SELECT doc_id,
         regexp_matches(
           regexp_replace(plain, '(?i)(?:never |not |don''t ){_ASKING}', '#', 'g'),
           '(?i){_ASKING}') AS asks_for_credentials,
         regexp_matches(plain, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]') AS has_digits,
         text <> plain AS changed_by_redaction
  FROM safe
)
SELECT *, asks_for_credentials OR has_digits OR changed_by_redaction AS is_unsafe
FROM flags""",
    "repeated_questions": f"""
WITH {_repeats("conversations", "conv_id", "turn", "WHERE role = 'user'")}
SELECT conv_id, turn, is_repeat FROM repeats""",
    "repeated_documents": f"""
WITH {_repeats("documents", "source", "doc_id")}
SELECT source, doc_id, is_repeat FROM repeats""",
    "support_answers": f"""
WITH safe AS (
  SELECT conv_id, turn, role, {_redacted(_STRIPPED.format("text"))} AS text FROM conversations
), {_routed("safe", "safe_")}, {_routed("conversations", "raw_")}, carried AS (
  SELECT s.*, r.text AS written,
         last_value(CASE WHEN r.role = 'user' THEN r.topic END IGNORE NULLS) OVER (
           PARTITION BY s.conv_id ORDER BY s.turn
           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS said
  FROM safe_routed s JOIN raw_routed r ON r.conv_id = s.conv_id AND r.turn = s.turn
), resolved AS (
  SELECT conv_id, turn, folded,
         coalesce(topic, CASE WHEN is_follow_up THEN said END) AS topic
  FROM carried
  WHERE role = 'user' AND length({_STRIPPED.format("written")}) BETWEEN 1 AND 500
), {_repeats("conversations", "conv_id", "turn", "WHERE role = 'user'")}
SELECT v.conv_id, v.turn, v.topic AS resolved_topic, v.variant, r.is_repeat
FROM (SELECT *, {_variant()} AS variant FROM resolved) v
JOIN repeats r ON r.conv_id = v.conv_id AND r.turn = v.turn""",
    "listed_mentions": f"""
WITH names AS (
  SELECT unnest([{", ".join(f"'{name}'" for name in LISTED_NAMES)}]) AS name
)
SELECT d.doc_id, 'word' AS kind, n.name
FROM documents d JOIN names n ON contains({_form('d.text')}, {_form('n.name')})""",
    "sanitized_messages": f"""
SELECT conv_id, turn, {_redacted('text')} AS content, role, role AS speaker
FROM conversations""",
    "synthetic_customers": _made("customers", "EXCLUDE (id) REPLACE (CAST(annual_income AS DOUBLE) AS annual_income)"),
    "synthetic_cards": _made("cards", "EXCLUDE (number, city, state)"),
    "synthetic_merchants": _made("merchants"),
    "synthetic_transactions": _made("transactions"),
    "quality_of_synthetic_tables": _with_dims(f"""
SELECT rule, dataset, "column", CAST(0 AS BIGINT) AS violations
FROM ({_quality({**_CLEAN_SET, "transactions": "described"})}) rules"""),
}
