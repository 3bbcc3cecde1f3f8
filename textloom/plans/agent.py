"""Queries of the barter agent, with their SQL: orders' lines stand for inventories, events for sends and offers, conversations for letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import trade
from .base import Book, table

book = Book()
# A supplier has the quantity it shipped of a brand; its goal is what it took back.
_STOCK = """have AS (SELECT l_suppkey AS agent, p_brand AS resource, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY ALL),
goal AS (SELECT l_suppkey AS agent, p_brand AS resource, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL),
over AS (SELECT h.agent, h.resource, h.qty - coalesce(g.qty, 0) AS n FROM have h LEFT JOIN goal g USING (agent, resource) WHERE h.qty > coalesce(g.qty, 0)),
lack AS (SELECT g.agent, g.resource, g.qty - coalesce(h.qty, 0) AS n FROM goal g LEFT JOIN have h USING (agent, resource) WHERE g.qty > coalesce(h.qty, 0))"""


def _stock(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag").where(F.col("l_returnflag").isin("A", "R"))
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("agent"), F.col("p_brand").alias("resource"), "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("qty"))
    return sums.where("l_returnflag = 'A'").drop("l_returnflag"), sums.where("l_returnflag = 'R'").drop("l_returnflag")


@book(f"WITH {_STOCK} SELECT agent, resource, 'over' AS side, CAST(n AS BIGINT) AS n FROM over UNION ALL SELECT agent, resource, 'lack', CAST(n AS BIGINT) FROM lack")
def surplus_deficit(spark, sf_dir):
    have, goal = _stock(spark, sf_dir)
    one = trade.surplus(have, goal).select("agent", "resource", F.lit("over").alias("side"), F.col("over").cast("long").alias("n"))
    return one.unionByName(trade.deficit(have, goal).select("agent", "resource", F.lit("lack").alias("side"), F.col("lack").cast("long").alias("n")))


@book(f"""WITH {_STOCK}, o AS (SELECT agent AS letter, (agent % (SELECT max(s_suppkey) + 1 FROM supplier)) AS giver, resource FROM over),
pair AS (SELECT o.letter, l.agent, o.resource FROM o JOIN supplier s ON s.s_suppkey = o.letter JOIN lack l ON l.agent = o.letter + 1 AND l.resource = o.resource)
SELECT letter, agent, min(resource) AS resource FROM pair GROUP BY letter, agent""")
def first_match_trade(spark, sf_dir):
    """Each supplier offers what it has over, in order of name, to the next one."""
    have, goal = _stock(spark, sf_dir)
    offers = trade.surplus(have, goal).select(F.col("agent").alias("letter"), (F.col("agent") + 1).alias("agent"), "resource", F.col("resource").alias("pos"))
    # brands differ in their digits, so they are spelled out for resource()
    spell = F.translate("resource", "0123456789#", "abcdefghijk")
    need = trade.deficit(have, goal).select("agent", spell.alias("resource"))
    out = trade.first_match(offers.withColumn("resource", spell), need)
    return out.select("letter", "agent", F.concat(F.lit("Brand#"), F.translate(F.substring("resource", 7, 9), "abcdefghij", "0123456789")).alias("resource"))


_PLAIN = "regexp_replace(regexp_replace(lower({0}), '[^a-záéíóúñü]+', '', 'g'), '^(.{{3,}})s$', '\\1')"


@book(rf"""WITH l AS (SELECT c_custkey, c_custkey % 5 AS form, n_name AS a, r_name AS b, replace(n_name, ' ', '') AS a1, replace(r_name, ' ', '') AS b1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(c_custkey AS BIGINT) AS letter, CASE WHEN form = 0 THEN {_PLAIN.format('b')} WHEN form < 3 THEN {_PLAIN.format('b1')} ELSE '' END AS wants, CASE WHEN form = 0 THEN {_PLAIN.format('a')} WHEN form < 3 THEN {_PLAIN.format('a1')} ELSE '' END AS gives FROM l""")
def offer_parse(spark, sf_dir):
    """A letter of each customer: structured, in words of two kinds, broken, or without an offer."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one, two = (F.replace(c, F.lit(" "), F.lit("")) for c in ("n_name", "r_name"))
    bodies = [trade.offer_text(F.col("n_name"), F.col("r_name")), F.format_string("Hola, te doy 1 %s a  cambio de\n1 %s", one, two), F.format_string("Ofrezco 1 %s por 1 %s, ¿vale?", one, two), F.concat(F.lit('[OFERTA_V1] quiero={'), one, F.lit("} ofrezco={}")), F.concat(F.lit("nada que ofrecer, "), one)]
    form = F.get(F.array(*bodies), (F.col("c_custkey") % 5).cast("int"))
    o = trade.offered(form)
    return rows.select(F.col("c_custkey").cast("long").alias("letter"), F.array_join(o["wants"], ",").alias("wants"), F.array_join(o["gives"], ",").alias("gives"))


@book("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (props IS NOT NULL AND json_valid(props)) AS BIGINT) AS objects FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", trade.object_in(F.concat(F.lit("Respuesta: "), F.col("props"))).alias("o"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("o").alias("objects"))


# A conversation's partner waits for the resource that its first word names, in every other conversation.
_SAID = rf"""p AS (SELECT conv_id, arg_min(split_part(text, ' ', 1), turn) AS wanted FROM conversations WHERE text IS NOT NULL AND conv_id % 2 = 0 GROUP BY conv_id),
t AS (SELECT c.conv_id, c.turn, c.role, wanted IS NOT NULL AS waits, {_PLAIN.format('wanted')} AS r, regexp_replace(regexp_replace(lower(c.text), '[^a-záéíóúüñ0-9\s]+', ' ', 'g'), '\s+', ' ', 'g') AS said FROM conversations c LEFT JOIN p USING (conv_id) WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, coalesce(waits AND role NOT IN ('sistema', 'system', 'admin') AND (regexp_matches(said, '{"|".join(trade.SIGNS)}') OR (r <> '' AND contains(replace(said, ' ', ''), r))), false) AS c FROM t)"""


def _letters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    pending = rows.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min_by(F.split_part("text", F.lit(" "), F.lit(1)), "turn").alias("wanted"))
    return rows, pending


@book(f"WITH {_SAID} SELECT conv_id AS conv, turn, c AS confirms FROM c")
def confirmations(spark, sf_dir):
    rows, pending = _letters(spark, sf_dir)
    joined = rows.join(pending, "conv_id", "left")
    return joined.select(F.col("conv_id").alias("conv"), "turn", trade.confirms(F.col("role"), F.lit(""), F.col("text"), F.col("wanted")).alias("confirms"))


@book(f"WITH {_SAID} SELECT conv_id AS agent, arg_min(turn, CASE WHEN c THEN 0 ELSE 1000000 END + turn) AS letter FROM c GROUP BY conv_id")
def inbox_priority(spark, sf_dir):
    rows, pending = _letters(spark, sf_dir)
    c = trade.confirms(F.col("role"), F.lit(""), F.col("text"), F.col("wanted"))
    return trade.next_letter(rows.join(pending, "conv_id", "left").select(F.col("conv_id").alias("agent"), F.col("turn").alias("letter"), F.col("turn").alias("pos"), c.alias("confirms")))


@book(f"""WITH {_STOCK} SELECT agent, min(o.resource) AS gives, min(l.resource) AS wants FROM over o JOIN lack l USING (agent) GROUP BY agent""")
def first_pairs(spark, sf_dir):
    have, goal = _stock(spark, sf_dir)
    pos = F.col("resource").alias("pos")
    return trade.first_pair(trade.surplus(have, goal).select("agent", "resource", pos), trade.deficit(have, goal).select("agent", "resource", pos))


@book("""SELECT CAST(a.s_suppkey AS BIGINT) AS agent, CAST(count(*) AS BIGINT) AS others FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND lower(trim(a.s_name)) <> lower(trim(b.s_name)) GROUP BY 1""")
def recipients(spark, sf_dir):
    """Whom each supplier may write to, of its nation."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("agent"), F.upper("s_name").alias("me"), "s_nationkey")
    rows = own.join(table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("alias")), "s_nationkey")
    return trade.recipients(rows, F.col("me")).groupBy("agent").agg(F.count("*").alias("others"))


@book("""SELECT event_id AS letter, user_id AS "user" FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 20 OR event_type = 'click')""")
def unanswered_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("letter"), F.col("user_id").alias("user"), "value", "event_type")
    return trade.unanswered(rows, rows.where("value > 20 or event_type = 'click'")).select("letter", "user")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("id"), "event_type")


@book("""WITH g AS (SELECT user_id AS user, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 180000000 THEN 0 ELSE 1 END AS s FROM events),
x AS (SELECT "user", sum(s) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT "user", CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY "user", session""")
def cooldown_sessions(spark, sf_dir):
    return trade.sessions(_events(spark, sf_dir), trade.COOLDOWN).groupBy("user", "session").agg(F.count("*").alias("n"))


@book("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t AS last, true AS sent FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t - r.last >= 21600000000 THEN e.t ELSE r.last END, e.t - r.last >= 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id AS "user", CAST(count(*) AS BIGINT) AS sent FROM r WHERE sent GROUP BY user_id""")
def cooldown_sends(spark, sf_dir):
    """With six hours between sends."""
    return trade.allowed_sends(_events(spark, sf_dir), 21600).groupBy("user").agg(F.count("*").alias("sent"))


@book("""WITH n AS (SELECT user_id AS "user", event_id AS id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS gap FROM events)
SELECT "user", CAST(count(*) FILTER (gap <= 900000000) AS BIGINT) AS replaced, CAST(count(*) FILTER (gap > 900000000 OR gap IS NULL) AS BIGINT) AS lapsed FROM n GROUP BY "user" """)
def pending_expiry(spark, sf_dir):
    """An offer lapses after 900 seconds unless the next one to its agent takes its place before."""
    from pyspark.sql import Window

    order = Window.partitionBy("user").orderBy("ts", "id")
    gap = F.lead(F.unix_micros(F.col("ts").cast("timestamp"))).over(order) - F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).select("user", gap.alias("gap"))
    soon = F.col("gap") <= trade.LAPSE * 1_000_000
    return rows.groupBy("user").agg(F.count_if(soon).alias("replaced"), F.count_if(~F.coalesce(soon, F.lit(False))).alias("lapsed"))


@book("""SELECT min(event_id) AS id, user_id AS "user", event_type, CAST(count(*) - 1 AS BIGINT) AS again FROM events GROUP BY user_id, event_type""")
def idempotent_ids(spark, sf_dir):
    """One letter of each agent and kind is processed; the others repeat it."""
    rows = _events(spark, sf_dir)
    first = rows.groupBy("user", "event_type").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("again"))
    return first.select("id", "user", "event_type", "again")


@book("""SELECT CAST(c_custkey AS BIGINT) AS customer, lower(trim(c_name)) AS alias, lower(trim(c_name)) IN ('sistema', 'system', 'admin') AS is_system FROM customer""")
def alias_forms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("customer"), T.alias(F.col("c_name")).alias("alias"), trade.is_system(F.col("c_name")).alias("is_system"))


@book("""SELECT n_name AS gives, r_name AS wants, '[OFERTA_V1] quiero={"' || r_name || '": 1} ofrezco={"' || n_name || '": 1}' || chr(10) || 'Te propongo 1x1: yo te doy 1 ' || n_name || ' si tú me das 1 ' || r_name || '.' AS letter FROM nation JOIN region ON n_regionkey = r_regionkey""")
def offer_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_name").alias("gives"), F.col("r_name").alias("wants"), trade.offer_text(F.col("n_name"), F.col("r_name")).alias("letter"))
