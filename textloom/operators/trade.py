"""Barter between agents: inventories, offers in letters, and what to answer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Senders that are the system, signs of a confirmation, and phrases of an offer in order of trial (fixed values).
SYSTEM = ["sistema", "system", "admin"]
SIGNS = ["confirm", "envi", "te he enviado", "te envi", "recibid", "hecho", "acepto", "vale", "ok", "de acuerdo"]
OFFERS = [
    r"te\s+doy\s+1\s+(\w+)\s+a\s+cambio\s+de\s+1\s+(\w+)",
    r"ofrezco\s*1\s+(\w+)\s+por\s+1\s+(\w+)",
    r"cambio\s+1\s+(\w+)\s+por\s+1\s+(\w+)",
    r"1\s+(\w+)\s+por\s+1\s+(\w+)",
]
#: Seconds: between two letters to one agent, until a sent letter is forgotten, until an offer lapses (fixed values).
COOLDOWN, FORGET, LAPSE = 180, 1800, 900


def surplus(have: DataFrame, goal: DataFrame) -> DataFrame:
    """(agent, resource, qty) each -> what an agent has beyond its goal, which is 0 where not named."""
    g = goal.select("agent", "resource", F.col("qty").alias("goal"))
    over = F.col("qty") - F.coalesce("goal", F.lit(0))
    return have.join(g, ["agent", "resource"], "left").where(over > 0).select("agent", "resource", over.alias("over"))


def deficit(have: DataFrame, goal: DataFrame) -> DataFrame:
    """What an agent lacks of its goal."""
    h = have.select("agent", "resource", F.col("qty").alias("has"))
    lack = F.col("qty") - F.coalesce("has", F.lit(0))
    return goal.join(h, ["agent", "resource"], "left").where(lack > 0).select("agent", "resource", lack.alias("lack"))


def first_match(offered: DataFrame, needed: DataFrame) -> DataFrame:
    """Offers (letter, agent, resource, pos) against what agents need: for each letter the first resource that fits."""
    need = needed.select("agent", T.resource(F.col("resource")).alias("r")).distinct()
    fits = offered.withColumn("r", T.resource(F.col("resource"))).join(need, ["agent", "r"], "left_semi")
    return fits.groupBy("letter", "agent").agg(F.min_by("resource", "pos").alias("resource"))


def offer_v1(body: Column) -> Column:
    """A structured offer's lists as struct(wants, gives): the keys of its two objects, or empty lists if it isn't one."""

    def keys(name: str) -> Column:
        found = F.regexp_extract(body, rf"(?s){name}\s*=\s*(\{{[^\n]*?\}})", 1)
        return F.when(found == "", F.array().cast("array<string>")).otherwise(F.transform(F.map_keys(F.from_json(found, "map<string,string>")), lambda k: T.resource(k)))

    wants, gives = keys("quiero"), keys("ofrezco")
    empty = F.array().cast("array<string>")
    good = body.contains("[OFERTA_V1]") & wants.isNotNull() & gives.isNotNull()
    return F.when(good, F.struct(wants.alias("wants"), gives.alias("gives"))).otherwise(F.struct(empty.alias("wants"), empty.alias("gives")))


def offer_1x1(body: Column) -> Column:
    """A plain offer as struct(gives, wants) by the first phrase that fits, else null."""
    low = T.collapse_spaces(F.lower(body))
    tries = [F.when(F.regexp_extract(low, f"(?U){p}", 1) != "", F.struct(T.resource(F.regexp_extract(low, f"(?U){p}", 1)).alias("gives"), T.resource(F.regexp_extract(low, f"(?U){p}", 2)).alias("wants"))) for p in OFFERS]
    return F.coalesce(*tries)


def offered(body: Column, other: Column | None = None) -> Column:
    """An offer's lists by trial: structured; else, where a list is empty, by phrase if it finds both; else `other`, a model's reading."""
    one, two = offer_v1(body), offer_1x1(body)
    lacking = (F.size(one["wants"]) == 0) | (F.size(one["gives"]) == 0)
    plain = F.struct(F.array(two["wants"]).alias("wants"), F.array(two["gives"]).alias("gives"))
    out = F.when(lacking & two.isNotNull(), plain)
    if other is not None:
        out = out.when(lacking, other)
    return out.otherwise(one)


def object_in(answer: Column) -> Column:
    """The JSON object in a model's answer: the whole, else from the first brace to the last; null if there is none."""
    inner = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(answer), F.try_parse_json(inner))


def offer_text(gives: Column, wants: Column) -> Column:
    return F.format_string('[OFERTA_V1] quiero={"%s": 1} ofrezco={"%s": 1}\nTe propongo 1x1: yo te doy 1 %s si tú me das 1 %s.', wants, gives, gives, wants)


def is_system(sender: Column) -> Column:
    return T.alias(sender).isin(*SYSTEM)


def confirms(sender: Column, subject: Column, body: Column, wanted: Column) -> Column:
    """Whether a letter from an agent with a pending offer (wanted isn't null) confirms it."""
    said = T.free_text(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))))
    sign = F.exists(F.array(*map(F.lit, SIGNS)), lambda s: said.contains(s))
    r = T.resource(wanted)
    return ~is_system(sender) & wanted.isNotNull() & (sign | ((r != "") & F.replace(said, F.lit(" ")).contains(r)))


def next_letter(inbox: DataFrame) -> DataFrame:
    """(agent, letter, pos, confirms) -> each agent's letter to read: the first that confirms, else the first."""
    return inbox.groupBy("agent").agg(F.min_by("letter", F.struct((~F.col("confirms")).alias("c"), "pos")).alias("letter"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """(user, ts, id) -> + session: a new one starts after so many seconds of silence."""
    order = Window.partitionBy("user").orderBy("ts", "id")
    quiet = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    return events.withColumn("session", F.sum(F.coalesce((quiet >= gap * 1_000_000).cast("long"), F.lit(1))).over(order))


def allowed_sends(events: DataFrame, gap: int) -> DataFrame:
    """(user, ts, id) -> those that a cooldown lets through, in order: a send it stops doesn't start it anew.
    What is let through depends on all before it, so each user's rows pass in order by a task that remembers one time."""
    rows = events.select("user", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("id").cast("long").alias("id"))
    ordered = rows.where("t is not null").repartition("user").sortWithinPartitions("user", "t", "id")

    def passed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        who = last = None
        for batch in batches:
            keep = []
            for user, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if user != who or last is None or t - last >= gap * 1_000_000:
                    who, last = user, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["user", "id"])

    return ordered.mapInArrow(passed, f"user {rows.schema['user'].dataType.simpleString()}, id long")


def recipients(people: DataFrame, me: Column) -> DataFrame:
    """(alias) rows that aren't oneself, nor without an alias."""
    return people.where((T.alias(F.col("alias")) != "") & ~T.same_alias(F.col("alias"), me))


def first_pair(over: DataFrame, lack: DataFrame) -> DataFrame:
    """(agent, resource, pos) each -> agent, gives, wants: the first that an agent has over and the first that it lacks."""
    one = over.groupBy("agent").agg(F.min_by("resource", "pos").alias("gives"))
    return one.join(lack.groupBy("agent").agg(F.min_by("resource", "pos").alias("wants")), "agent")


def unanswered(letters: DataFrame, answered: DataFrame) -> DataFrame:
    """Letters whose id isn't among those answered."""
    return letters.join(answered.select("letter").distinct(), "letter", "left_anti")


def confirmations(letters: DataFrame, pending: DataFrame) -> DataFrame:
    """(letter, sender, subject, body) and pending offers (sender, wanted): each letter with whether it confirms its sender's."""
    wanted = pending.select(T.alias(F.col("sender")).alias("by"), "wanted")
    rows = letters.join(wanted, T.alias(F.col("sender")) == F.col("by"), "left")
    return rows.select("letter", "sender", confirms(F.col("sender"), F.col("subject"), F.col("body"), F.col("wanted")).alias("confirms"))
