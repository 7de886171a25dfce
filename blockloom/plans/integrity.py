"""Hash, checksum and parity queries."""

from pyspark.sql import functions as F

from blockloom.operators import integrity as it
from blockloom.plans.registry import query
from blockloom.sources.driver_model import ACTIVATION_DELAY, GAS_TICK


def jtext(*pairs: tuple[str, str]) -> str:
    """SQL for a JSON object; kind `n` is a number, `s` a string, both NULL-aware."""
    parts = []
    for i, (name, kind) in enumerate(pairs):
        value = f"coalesce(CAST({name} AS VARCHAR), 'null')" if kind == "n" else f"coalesce('\"' || {name} || '\"', 'null')"
        parts.append(f"'{'{' if i == 0 else ','}\"{name}\":' || {value}")
    return " || ".join(parts) + " || '}'"


LEDGER_JSON = jtext(("action_index", "n"), ("address", "s"), ("tick", "s"), ("amount", "s"))


def ledger_agg(name: str) -> str:
    return f"""{name}_t AS (SELECT block_index, string_agg({LEDGER_JSON}, ',' ORDER BY action_index, address, tick, amount) AS t FROM (
      SELECT a.block_index, x.action_index, i.address, k.tick, x.amount FROM {name} x JOIN actions a ON a.action_index = x.action_index
      LEFT JOIN index_addresses i ON i.id = x.address_id LEFT JOIN index_tickers k ON k.id = x.tick_id) GROUP BY 1)"""


def tail(hash_name: str) -> str:
    return f""" || '"block_index":' || b.block_index || CASE WHEN p.block_index IS NULL THEN '' ELSE ',"previous_hash":' || coalesce('"' || p.{hash_name} || '"', 'null') END || ',"hash_version":1}}'"""


def execution_tables(m):
    urgent = m.actions.where("action = '1-URGENT'")
    executions = urgent.select("action_index", F.col("source_id").alias("contract_index"), (F.col("source_id") % 100).alias("caller_id"),
                               F.col("tx_index").cast("string").alias("gas_used"), F.lit(1).cast("bigint").alias("status_id"), F.lit(2).alias("emitted_count"))
    emissions = m.ledger_base.select(F.col("action_index").alias("execution_index"), F.col("l_returnflag").alias("emitted_action"),
                                     F.col("address_id").alias("action_index"), F.col("l_linenumber").alias("position"))
    return executions, emissions


BLOCK_HASH_SQL = f"""WITH {ledger_agg('credits')}, {ledger_agg('debits')}, {ledger_agg('escrows')},
    actions_t AS (SELECT block_index, string_agg('"' || rn || '":' || {jtext(("action_index", "n"), ("tx_index", "n"), ("action", "s"))}, ',' ORDER BY action_index) AS t FROM
      (SELECT *, row_number() OVER (PARTITION BY block_index ORDER BY action_index) - 1 AS rn FROM actions) GROUP BY 1),
    state_t AS (SELECT block_index, string_agg({jtext(("contract_index", "n"), ("state_key", "s"), ("state_value", "s"))}, ',' ORDER BY contract_index, state_key) AS t FROM contract_state
      WHERE id IN (SELECT max(id) FROM contract_state GROUP BY block_index, contract_index, state_key) GROUP BY 1),
    runs AS (SELECT action_index, source_id AS contract_index, i.address AS caller_address, CAST(tx_index AS VARCHAR) AS gas_used, 'valid' AS status, 2 AS emitted_count, a.block_index
      FROM actions a LEFT JOIN index_addresses i ON i.id = a.source_id % 100 WHERE action = '1-URGENT'),
    runs_t AS (SELECT block_index, string_agg({jtext(("action_index", "n"), ("contract_index", "n"), ("caller_address", "s"), ("gas_used", "s"), ("status", "s"), ("emitted_count", "n"))}, ',' ORDER BY action_index) AS t FROM runs GROUP BY 1),
    em AS (SELECT r.block_index, l.action_index AS execution_index, l.l_returnflag AS emitted_action, l.address_id AS action_index, l.l_linenumber AS position FROM ledger_base l JOIN runs r ON r.action_index = l.action_index),
    em_j AS (SELECT *, {jtext(("execution_index", "n"), ("emitted_action", "s"), ("action_index", "n"), ("position", "n"))} AS j FROM em),
    em_t AS (SELECT block_index, string_agg(j, ',' ORDER BY execution_index, position, j) AS t FROM em_j GROUP BY 1)
    SELECT b.block_index,
      sha256('{{"credits":[' || coalesce(c.t, '') || '],"debits":[' || coalesce(d.t, '') || '],"escrows":[' || coalesce(e.t, '') || '],' {tail('ledger_hash')}) AS ledger_hash,
      sha256('{{' || coalesce(a.t || ',', '') {tail('actions_hash')}) AS actions_hash,
      sha256('{{"contracts":[],"state":[' || coalesce(s.t, '') || '],"executions":[' || coalesce(r.t, '') || '],"emissions":[' || coalesce(m.t, '') || '],"deposits":[],"withdrawals":[],' {tail('contract_hash')}) AS contract_hash
    FROM blocks b LEFT JOIN blocks p ON p.block_index = b.block_index - 1 LEFT JOIN credits_t c ON c.block_index = b.block_index LEFT JOIN debits_t d ON d.block_index = b.block_index
    LEFT JOIN escrows_t e ON e.block_index = b.block_index LEFT JOIN actions_t a ON a.block_index = b.block_index LEFT JOIN state_t s ON s.block_index = b.block_index
    LEFT JOIN runs_t r ON r.block_index = b.block_index LEFT JOIN em_t m ON m.block_index = b.block_index"""
BLOCK_TABLES = ("credits", "debits", "escrows", "actions", "blocks", "index_addresses", "index_tickers", "contract_state")


def block_tables(m):
    executions, emissions = execution_tables(m)
    return {**m.ledger_tables(m.ledger_in_blocks, "block_index"), "actions": m.actions, "contract_state": m.contract_state,
            "contract_executions": executions, "contract_emissions": emissions, "index_addresses": m.index_addresses,
            "index_tickers": m.index_tickers, "index_statuses": m.statuses}


@query("block_hashes", BLOCK_HASH_SQL, BLOCK_TABLES)
def block_hashes(m):
    return it.block_hashes(block_tables(m), m.blocks)


def state_class(name: str, source: str, pairs: list[tuple[str, str]], order: str) -> str:
    return f"{name} AS (SELECT block_index, string_agg(j, ',' ORDER BY {order}, j) AS t FROM (SELECT *, {jtext(*pairs)} AS j FROM ({source})) GROUP BY 1)"


N = ("action_index", "n")
CLASSES = [
    state_class("c1", "SELECT action_index, deactivation_block, deactivation_block - 6 AS block_index FROM stakes", [N, ("deactivation_block", "n")], "action_index"),
    state_class("c2", "SELECT action_index, deactivation_block, deactivation_block - 6 AS block_index FROM delegations", [N, ("deactivation_block", "n")], "action_index"),
    state_class("c3", "SELECT DISTINCT s.action_index, s.amount, d.block_index FROM stakes s JOIN slash_debits d ON d.stake_action_index = s.action_index AND d.target_table = 'stakes'", [N, ("amount", "s")], "action_index"),
    state_class("c4", "SELECT *, resolved_block AS block_index FROM attests WHERE version = 0", [N, ("request_status", "s"), ("resolved_block", "n")], "action_index"),
    state_class("c5", "SELECT *, resolved_block AS block_index FROM xcalls WHERE version = 0", [N, ("request_status", "s"), ("resolved_block", "n")], "action_index"),
    state_class("c6", "SELECT u.action_index, n.status, cooldown_end_block AS block_index FROM unstakes u LEFT JOIN statuses n ON n.id = u.status_id", [N, ("status", "s")], "action_index"),
    state_class("c7", "SELECT u.action_index, n.status, cooldown_end_block AS block_index FROM contract_unstakes u LEFT JOIN statuses n ON n.id = u.status_id", [N, ("status", "s")], "action_index"),
    state_class("c8", """SELECT c.action_index, i.address, k.tick, c.amount, u.cooldown_end_block AS block_index FROM credits c JOIN unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id
        JOIN index_tickers k ON k.id = c.tick_id AND k.tick = 'TICK0' LEFT JOIN index_addresses i ON i.id = c.address_id WHERE u.status_id = 3
        UNION ALL SELECT c.action_index, i.address, k.tick, c.amount, u.cooldown_end_block FROM credits c JOIN contract_unstakes u ON u.action_index = c.action_index AND u.source_id = c.address_id AND u.tick_id = c.tick_id
        LEFT JOIN index_tickers k ON k.id = c.tick_id LEFT JOIN index_addresses i ON i.id = c.address_id WHERE u.status_id = 3""",
        [N, ("address", "s"), ("tick", "s"), ("amount", "s")], "action_index, address, tick, amount"),
    state_class("c9", """SELECT p.action_index, 'invalid_archive' AS status, c.block_index_doge AS block_index FROM anchors p JOIN anchors c ON c.version = 2 AND c.match_batch_seq = p.match_batch_seq
        WHERE p.version IN (1, 6) AND p.status_id = 9 AND c.status_id = 1""", [N, ("status", "s")], "action_index"),
    state_class("c10", "SELECT id, address, block_index FROM index_addresses WHERE block_index IS NOT NULL", [("id", "n"), ("address", "s")], "id"),
    state_class("c11", "SELECT id, tick, block_index FROM index_tickers WHERE block_index IS NOT NULL", [("id", "n"), ("tick", "s")], "id"),
    state_class("c12", """SELECT DISTINCT a.block_index, k.tick, t.supply FROM (SELECT action_index, tick_id FROM credits UNION ALL SELECT action_index, tick_id FROM debits UNION ALL SELECT action_index, tick_id FROM escrows) l
        JOIN actions a ON a.action_index = l.action_index JOIN tokens t ON t.tick_id = l.tick_id JOIN index_tickers k ON k.id = l.tick_id""", [("tick", "s"), ("supply", "s")], "tick"),
    state_class("c13", """SELECT f.action_index, n.status AS feed_status, closed_block, terminal_block, b.block_index FROM bet_feeds f JOIN statuses n ON n.id = f.feed_status_id
        JOIN (SELECT action_index, closed_block AS block_index FROM bet_feeds UNION SELECT action_index, terminal_block FROM bet_feeds) b ON b.action_index = f.action_index WHERE b.block_index IS NOT NULL""",
        [N, ("feed_status", "s"), ("closed_block", "n"), ("terminal_block", "n")], "action_index"),
    state_class("c14", "SELECT b.action_index, n.status AS bet_status, settled_block, settled_block AS block_index FROM bets b JOIN statuses n ON n.id = b.bet_status_id WHERE settled_block IS NOT NULL",
                [N, ("bet_status", "s"), ("settled_block", "n")], "action_index"),
]
TEXTS = {f"c{i}": f"coalesce(c{i}.t, '')" for i in range(1, 15)}
STATE_SQL = f"""WITH {', '.join(CLASSES)} SELECT b.block_index, sha256('{{"deactivations":{{"stakes":[' || {TEXTS['c1']} || '],"delegations":[' || {TEXTS['c2']} || '],"contract_stakes":[],"contract_delegations":[]}}'
      || ',"slashes":{{"stakes":[' || {TEXTS['c3']} || '],"unstakes":[],"contract_stakes":[],"contract_unstakes":[]}},"request_status":{{"attests":[' || {TEXTS['c4']} || '],"xcalls":[' || {TEXTS['c5']}
      || ']}},"cooldown":{{"unstakes":[' || {TEXTS['c6']} || '],"contract_unstakes":[' || {TEXTS['c7']} || ']}},"credits":[' || {TEXTS['c8']} || '],"anchor_invalid":[' || {TEXTS['c9']}
      || '],"index_addresses_new":[' || {TEXTS['c10']} || '],"index_tickers_new":[' || {TEXTS['c11']} || '],"poll_finalize":[],"token_supply":[' || {TEXTS['c12']} || '],"bet_feed_status":[' || {TEXTS['c13']}
      || '],"bet_status":[' || {TEXTS['c14']} || '],"block_index":' || b.block_index || ',"state_hash_version":1}}') AS state_hash
    FROM blocks b {' '.join(f'LEFT JOIN c{i} ON c{i}.block_index = b.block_index' for i in range(1, 15))}"""


@query("state_hash", STATE_SQL, ("blocks", "stakes", "delegations", "slash_debits", "attests", "xcalls", "unstakes", "contract_unstakes", "statuses", "credits", "debits", "escrows",
                                 "actions", "tokens", "index_addresses", "index_tickers", "anchors", "bet_feeds", "bets"))
def state_hash(m):
    tables = {"stakes": m.stakes, "delegations": m.delegations, "capability_slash_debits": m.slash_debits, "attests": m.attests, "xcalls": m.xcalls,
              "unstakes": m.unstakes, "contract_unstakes": m.contract_unstakes, "index_statuses": m.statuses, "credits": m.credits, "debits": m.debits,
              "escrows": m.escrows, "actions": m.actions, "tokens": m.tokens, "index_addresses": m.index_addresses, "index_tickers": m.index_tickers,
              "anchor_actions": m.anchors, "bet_feeds": m.bet_feeds, "bets": m.bets}
    return it.state_hashes(tables, m.blocks, ACTIVATION_DELAY, "BTC", "regtest", GAS_TICK)


@query("index_map_checksum", f"""SELECT CAST(2000 AS BIGINT) AS block_index, sha256('{{"index_map":[' || string_agg('{{"id":"' || id || '","address":"' || address || '"}}', ',' ORDER BY id) || ']}}') AS checksum
    FROM index_addresses WHERE block_index IS NOT NULL AND block_index <= 2000""", ("index_addresses",))
def index_map_checksum(m):
    return it.index_map_checksum(m.index_addresses, 2000)


def row_text(*cols: str) -> str:
    return jtext(*[(c, "s") for c in sorted(cols)])


LEDGER_COLS = ("action_index", "address_id", "tick_id", "amount")


def digest_sql(sources: dict[str, tuple[str, tuple[str, ...]]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", sha256({row_text(*cols)}) AS h FROM (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)} FROM {src})"
                              for t, (src, cols) in sources.items())
    steps, prev = [f"l0 AS (SELECT \"table\", substr(h, 1, 6) AS b, h || ':' || count(*) AS d, count(*) AS n FROM ({rows}) GROUP BY \"table\", h)"], "l0"
    for i, digits in enumerate((4, 2, 0)):
        steps.append(f"""f{i} AS (SELECT "table", b, sha256(string_agg(d, ',' ORDER BY d)) AS x, CAST(sum(n) AS BIGINT) AS n FROM {prev} GROUP BY "table", b),
          g{i} AS (SELECT "table", substr(b, 1, {digits}) AS b, b || ':' || x AS d, n FROM f{i})""")
        prev = f"g{i}"
    return ", ".join(steps) + f""", digests AS (SELECT "table", CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, ',' ORDER BY d)) AS digest FROM {prev} GROUP BY "table")"""


BAGS = {t: (t, LEDGER_COLS) for t in ("credits", "debits", "escrows")}


@query("content_digest", f"WITH {digest_sql({**BAGS, 'blocks': ('blocks', ('block_index', 'block_time', 'ledger_hash', 'actions_hash', 'contract_hash'))})} SELECT * FROM digests",
       ("credits", "debits", "escrows", "blocks"))
def content_digest(m):
    return it.content_digests({"credits": m.credits, "debits": m.debits, "escrows": m.escrows, "blocks": m.blocks})


@query("content_digest_exact", f"""SELECT 'stakes' AS "table", sha256('{{"table":"stakes","rows":[' || string_agg('"' || replace(j, '"', '\\"') || '"', ',' ORDER BY j) || ']}}') AS digest FROM (
      SELECT {row_text('action_index', 'source_id', 'amount', 'deactivation_block')} AS j FROM (SELECT CAST(action_index AS VARCHAR) AS action_index, CAST(source_id AS VARCHAR) AS source_id, amount, CAST(deactivation_block AS VARCHAR) AS deactivation_block FROM stakes))
    UNION ALL SELECT 'blocks', sha256('{{"table":"blocks","rows":[' || string_agg('"' || replace(j, '"', '\\"') || '"', ',' ORDER BY j) || ']}}') FROM (
      SELECT {row_text('block_index', 'block_time')} AS j FROM (SELECT CAST(block_index AS VARCHAR) AS block_index, CAST(block_time AS VARCHAR) AS block_time FROM blocks))""", ("stakes", "blocks"))
def content_digest_exact(m):
    return it.exact_content_digests({"stakes": m.stakes.select("action_index", "source_id", "amount", "deactivation_block"),
                                     "blocks": m.blocks.select("block_index", "block_time")})


REPLICA = {"credits": "(SELECT action_index, address_id, tick_id, CASE WHEN tick_id = 3 AND address_id = 7 THEN amount || '0' ELSE amount END AS amount FROM credits)",
           "debits": "(SELECT * FROM debits WHERE NOT (address_id = 7 AND tick_id < 3))", "actions": "actions", "transactions": "transactions"}
SOURCE = {"credits": "credits", "debits": "debits", "escrows": "escrows", "actions": "actions"}
COLS = {"credits": LEDGER_COLS, "debits": LEDGER_COLS, "escrows": LEDGER_COLS, "actions": ("action_index", "block_index", "tx_index", "action", "source_id"),
        "transactions": ("tx_index", "block_index", "source_id")}


def windowed(table: str, source: str) -> str:
    if table in ("actions", "transactions"):
        return f"(SELECT * FROM {source} WHERE block_index BETWEEN 1001 AND 2000)"
    return f"(SELECT x.* FROM {source} x JOIN actions a ON a.action_index = x.action_index WHERE a.block_index BETWEEN 1001 AND 2000)"


def parity_frames(m):
    replica = {"credits": m.credits.withColumn("amount", F.when((F.col("tick_id") == 3) & (F.col("address_id") == 7), F.concat("amount", F.lit("0"))).otherwise(F.col("amount"))),
               "debits": m.debits.where("not (address_id = 7 and tick_id < 3)"), "actions": m.actions, "transactions": m.transactions}
    source = {"credits": m.credits, "debits": m.debits, "escrows": m.escrows, "actions": m.actions}
    return source, replica


@query("content_parity", f"""WITH {digest_sql({t: (windowed(t, s), COLS[t]) for t, s in SOURCE.items()}).replace('digests AS', 'src AS').replace('l0', 'sl0').replace('f0 ', 'sf0 ').replace('f1 ', 'sf1 ').replace('f2 ', 'sf2 ').replace('f0)', 'sf0)').replace('f1)', 'sf1)').replace('f2)', 'sf2)').replace('g0 ', 'sg0 ').replace('g1 ', 'sg1 ').replace('g2 ', 'sg2 ')},
    {digest_sql({t: (windowed(t, s), COLS[t]) for t, s in REPLICA.items()}).replace('digests AS', 'rep AS')}
    SELECT coalesce(src."table", rep."table") AS "table", rep.n_rows AS local_rows, src.n_rows AS remote_rows, CASE WHEN rep.n_rows IS NULL THEN 'skipped: absent locally' WHEN src.n_rows IS NULL THEN 'skipped: absent on source'
      WHEN rep.n_rows <> src.n_rows THEN 'skipped: row count differs' WHEN rep.digest <> src.digest THEN 'mismatch' ELSE 'match' END AS verdict FROM src FULL JOIN rep ON src."table" = rep."table" """,
       ("credits", "debits", "escrows", "actions", "transactions"))
def content_parity(m):
    source, replica = parity_frames(m)
    plan = {"credits": "action", "debits": "action", "escrows": "action", "actions": "action", "transactions": "block"}
    cut = lambda t: it.content_digests(it.parity_windows(t, plan, 2000, 1000, {}))
    return it.compare_content(cut(replica), cut(source))


@query("count_parity", f"""SELECT 'debits' AS "table", (SELECT count(*) FROM debits) AS source_count, (SELECT count(*) FROM {REPLICA['debits']}) AS local_count,
      (SELECT count(*) FROM debits) - (SELECT count(*) FROM {REPLICA['debits']}) AS delta, 'replica-short' AS reason
    UNION ALL SELECT 'escrows', (SELECT count(*) FROM escrows), CAST(0 AS BIGINT), (SELECT count(*) FROM escrows), 'replica-short'""", ("debits", "escrows"))
def count_parity(m):
    from blockloom.operators.aggregates import table_counts
    source, replica = parity_frames(m)
    return it.compare_counts(table_counts(source), table_counts(replica), True, ["credits", "actions"])


@query("missing_tables", """SELECT DISTINCT p_name AS "table" FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)""")
def missing_tables(m):
    from blockloom.operators.scan import missing_tables as missing
    parts = m.table("part").withColumnRenamed("p_name", "table")
    return missing(parts, parts.where("p_size < 3"))


@query("hash_mismatches", """SELECT block_index, 'ledger_hash' AS field, ledger_hash AS a, 'x' || ledger_hash AS b FROM blocks WHERE block_index % 9 = 0 AND ledger_hash IS NOT NULL
    UNION ALL SELECT block_index, 'contract_hash', contract_hash, NULL FROM blocks WHERE block_index % 11 = 0 AND contract_hash IS NOT NULL""", ("blocks",))
def hash_mismatches(m):
    b = F.col("block_index")
    other = m.blocks.withColumns({"ledger_hash": F.when(b % 9 == 0, F.concat(F.lit("x"), "ledger_hash")).otherwise(F.col("ledger_hash")),
                                  "contract_hash": F.when(b % 11 != 0, F.col("contract_hash"))})
    return it.compare_block_hashes(m.blocks, other)


@query("broken_continuity", """SELECT block_index FROM (SELECT DISTINCT block_index FROM blocks) b WHERE block_index - 1 NOT IN (SELECT block_index FROM blocks)
    AND block_index > (SELECT min(block_index) FROM blocks)""", ("blocks",))
def broken_continuity(m):
    return it.broken_continuity(m.blocks)


@query("roots_vs_committed", """SELECT block_index, 'ledger_hash' AS field, ledger_hash AS computed, 'bad' AS committed FROM blocks WHERE block_index % 9 = 0""", ("blocks",))
def roots_vs_committed(m):
    committed = m.blocks.select("block_index", F.when(F.col("block_index") % 9 == 0, "bad").otherwise(F.upper("ledger_hash")).alias("ledger_hash"))
    return it.compare_roots(m.blocks, committed, ["ledger_hash"])
