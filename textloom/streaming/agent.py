"""The barter agent: letters come in, answers go out, and what is remembered of each sender lapses.

stream() answers letters of any number of senders as a streaming query with state by sender; Agent is one agent's
own loop against its server, with a mailbox of which one letter is read at a turn.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..functions import text as T
from ..operators import trade
from ..sources.butler import Butler

ANSWERS = "sender string, letter string, outcome string, body string"
_STATE = "last_sent double, gives string, wants string, offered_at double, done array<struct<letter:string,at:double>>"
#: Seconds between turns, least and most, after an error, and the chance of an offer where there is mail (fixed values).
SLEEP, RETRY, OFFER = (5, 12), 2, 0.5
#: How long an id that was answered is known, in seconds.
REMEMBER = 24 * 3600


def _timestamp(letters: DataFrame):
    at = F.col("at")  # a cast would lose the watermark
    return at if isinstance(letters.schema["at"].dataType, TimestampType) else at.cast("timestamp").alias("at")


def parsed(letters: DataFrame) -> DataFrame:
    """(letter, sender, subject, body, at) with what a letter offers (wants, gives), what it says in plain letters, and who
    it is from: system."""
    o = trade.offered(F.coalesce("body", F.lit("")))
    said = T.free_text(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    return letters.select("letter", "sender", _timestamp(letters), o["wants"].alias("wants"), o["gives"].alias("gives"), said.alias("said"), trade.is_system(F.col("sender")).alias("system"))


def plain(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """Resources by their plain names, as letters are held against them."""
    rows = spark.createDataFrame(list(enumerate(names)), "k int, name string").orderBy("k").select(T.resource(F.col("name")).alias("r"), "name").collect() if names else []
    return {r["r"]: r["name"] for r in reversed(rows)}


def confirmed(said: str, wants: str) -> bool:
    """Whether what a letter says confirms a pending offer; wants is a plain name. The rule of trade.confirms()."""
    return any(s in said for s in trade.SIGNS) or bool(wants) and wants in said.replace(" ", "")


def answer(surplus: dict[str, str], deficit: dict[str, str], own: str = "") -> Callable:
    """The stateful step for one sender; surplus and deficit by plain name. Letters in order of time: own ones, the system's and answered
    ones are passed over; a pending offer that a letter confirms is settled if what it gives is over still; an offer that gives what is lacking
    for what is over is taken, at most once in the cooldown; else a counter-offer is made and waits for LAPSE seconds.
    State of a sender who is silent until the watermark is REMEMBER past its newest letter goes."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, gives, wants, offered_at, done = state.get if state.exists else (None, None, None, None, [])
        known = {d[0]: d[1] for d in done or []}
        name, out = (key[0] or "").strip().lower(), []
        # a sender's letters of one trigger
        rows = pd.concat(list(batches)).sort_values(["at", "letter"])
        for r in rows.itertuples():
            now = r.at.timestamp()
            if offered_at is not None and now - offered_at > trade.LAPSE:
                gives = wants = offered_at = None
            if last is not None and now - last > trade.FORGET:
                last = None
            if r.letter in known or r.system or name == own.strip().lower():
                continue
            free = last is None or now - last >= trade.COOLDOWN
            gets = next((deficit[x] for x in r.gives if x in deficit), None)
            pays = next((surplus[x] for x in r.wants if x in surplus), None)
            body = None
            if wants is not None and confirmed(r.said, wants):
                if gives in surplus:
                    outcome, body = "confirmed", settled(surplus[gives])
                    gives = wants = offered_at = None
                else:
                    outcome = "no longer over"
            elif gets and pays and free:
                outcome, body, last = "accepted", accepted(pays, gets), now
            elif free and surplus and deficit:
                gives, wants = next(iter(surplus)), next(iter(deficit))
                outcome, body, last, offered_at = "offered", offer(surplus[gives], deficit[wants]), now, now
            else:
                outcome = "waiting"
            if body:  # an id counts as answered only when something was sent
                known[r.letter] = now
            out.append((key[0], r.letter, outcome, body))
        if len(rows):
            newest = rows["at"].max().timestamp()
            state.update((last, gives, wants, offered_at, [(k, at) for k, at in known.items() if newest - at < REMEMBER]))
            state.setTimeoutTimestamp(int((newest + REMEMBER) * 1000))
        yield pd.DataFrame({c: pd.Series([o[i] for o in out], dtype=object) for i, c in enumerate(("sender", "letter", "outcome", "body"))})

    return step


def run(letters: DataFrame, surplus: list[str], deficit: list[str], own: str = "", within: str = "24 hours") -> DataFrame:
    """A streaming DataFrame of letters (letter, sender, subject, body, at) -> answers. A letter that the source gives twice within
    the watermark counts once."""
    spark = letters.sparkSession
    step = answer(plain(spark, surplus), plain(spark, deficit), own)
    return parsed(once(letters, within)).groupBy("sender").applyInPandasWithState(step, ANSWERS, _STATE, "append", "EventTimeTimeout")


def once(letters: DataFrame, within: str = "24 hours") -> DataFrame:
    """Letters without those whose id came before, as far back as the watermark."""
    return letters.withColumn("at", _timestamp(letters)).withWatermark("at", within).dropDuplicatesWithinWatermark(["letter"])


# letters (fixed values)


def offer(gives: str, wants: str) -> str:
    return f'[OFERTA_V1] quiero={{"{wants}": 1}} ofrezco={{"{gives}": 1}}\nTe propongo 1x1: yo te doy 1 {gives} si tú me das 1 {wants}.'


def accepted(pays: str, gets: str) -> str:
    return f"¡Hecho! Acepto el cambio 🙂\nTe he enviado 1 de {pays}.\nCuando puedas, envíame 1 de {gets}."


def settled(gives: str) -> str:
    return f"¡Gracias! Recibido 🙂\nTe envío 1 de {gives} como acordamos."


@dataclass
class Agent:
    """One agent's loop against its server. `spark` reads letters by the same columns as the stream; reader(body) may read an offer (wants,
    gives) that the rules can't, such as by a language model."""

    spark: SparkSession
    server: Butler
    reader: Callable[[str], tuple[list[str], list[str]]] | None = None
    draw: random.Random = field(default_factory=random.Random)
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    sent: dict[str, float] = field(default_factory=dict)  # when a letter last went to whom
    pending: dict[str, tuple[str, str, float]] = field(default_factory=dict)  # offers by whom they went to: gives, wants, when
    done: set[str] = field(default_factory=set)

    def run(self, turns: int | None = None) -> None:
        n = 0
        while turns is None or n < turns:
            n += 1
            self.sleep(self.draw.randint(*SLEEP) if self.turn() is not None else RETRY)

    def turn(self) -> str | None:
        """One poll: state lapses, one letter at most is read, and an offer may go out. What became of the letter; null if the server failed."""
        info = self.server.info()
        if info is None:
            return None
        have, goal, me, inbox = info
        over = {k: v - goal.get(k, 0) for k, v in have.items() if v > goal.get(k, 0)}
        lack = {k: v - have.get(k, 0) for k, v in goal.items() if have.get(k, 0) < v}
        now = self.clock()
        self.pending = {k: v for k, v in self.pending.items() if now - v[2] <= trade.LAPSE}
        self.sent = {k: t for k, t in self.sent.items() if t >= now - trade.FORGET}
        if not inbox:
            self._offer(me, over, lack)
            return "no letter"
        outcome = self._read(me, have, over, lack, inbox)
        if self.draw.random() < OFFER:
            self._offer(me, over, lack)
        return outcome

    def _read(self, me: str, have: dict, over: dict, lack: dict, inbox: dict) -> str:
        letters = list(inbox.values())
        rows = self.spark.createDataFrame([(i, x.get("id"), x.get("remi"), x.get("asunto"), x.get("cuerpo")) for i, x in enumerate(letters)], "k int, letter string, sender string, subject string, body string")
        read = {r["k"]: r for r in parsed(rows.withColumn("at", F.lit(0).cast("timestamp"))).join(rows.select("k", "letter", "sender"), ["letter", "sender"]).collect()}  # a mailbox
        plain_over, plain_lack = plain(self.spark, list(over)), plain(self.spark, list(lack))
        wants = plain(self.spark, [p[1] for p in self.pending.values()])
        by_name = {v: k for k, v in wants.items()}

        def confirms(i: int) -> bool:
            sender = letters[i].get("remi", "")
            return i in read and not read[i]["system"] and sender in self.pending and confirmed(read[i]["said"], by_name.get(self.pending[sender][1], ""))

        first = next((i for i in range(len(letters)) if confirms(i)), 0)
        letter, sender = letters[first], letters[first].get("remi", "")
        if (sender or "").strip().lower() == (me or "").strip().lower():
            return "own letter"  # neither read nor removed
        if confirms(first):
            outcome = self._settle(me, sender, have, plain_over)
        else:
            outcome = self._consider(me, letter, read.get(first), have, plain_over, plain_lack)
        self.server.remove(letter.get("id"))
        return outcome

    def _settle(self, me: str, sender: str, have: dict, over: dict[str, str]) -> str:
        gives, _, _ = self.pending[sender]
        name = next(iter(plain(self.spark, [gives])), "")
        if name not in over or have.get(over[name], 0) < 1:
            return "no longer over"
        if not self.server.send_goods(me, sender, {over[name]: 1}):
            return "not sent"
        self.server.send_letter(me, sender, "Confirmación de envío", settled(over[name]))
        del self.pending[sender]
        return "confirmed"

    def _consider(self, me: str, letter: dict, row, have: dict, over: dict[str, str], lack: dict[str, str]) -> str:
        if row is None or row["system"] or letter.get("id") in self.done:
            return "passed over"
        asks, gives = row["wants"], row["gives"]
        if (not asks or not gives) and self.reader:
            asks, gives = (list(plain(self.spark, x)) for x in self.reader(letter.get("cuerpo") or ""))
        gets, pays = next((lack[x] for x in gives if x in lack), None), next((over[x] for x in asks if x in over), None)
        if not gets or not pays or have.get(pays, 0) < 1:
            return "declined"
        if not self.server.send_goods(me, letter.get("remi", ""), {pays: 1}):
            return "not sent"
        self.server.send_letter(me, letter.get("remi", ""), "Confirmación de trueque", accepted(pays, gets))
        self.done.add(letter.get("id"))
        return "accepted"

    def _offer(self, me: str, over: dict, lack: dict) -> None:
        if not over or not lack:
            return
        others = [p for p in self.server.people() if p and p.strip().lower() != (me or "").strip().lower()]
        if not others:
            return
        to, now = self.draw.choice(others), self.clock()
        if to in self.sent and now - self.sent[to] < trade.COOLDOWN:
            return
        gives, wants = next(iter(over)), next(iter(lack))
        if self.server.send_letter(me, to, "Propuesta 1x1", offer(gives, wants)):
            self.sent[to] = now
            self.pending[to] = (gives, wants, now)
