"""Made-up chats: a small fixed one, and a generator that scales with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("Asha", "Ben", "Chitra", "Dev", "Esha", "Farid", "Gita", "Hari", "Indra")
VOCABULARY = "meeting photo share place event time train booking result test lunch office report weather garden music film market bridge river station ticket library letter window winter summer holiday paper game coffee train plan call road school kitchen doctor".split()
TEMPLATES = ("good morning everyone", "please share the photos", "happy birthday", "see you at the event", "call +91 98765 43210 today", "join https://example.com/meet now")
#: The demo: a header line and 37 rows.
SMALL = (
    "Messages are end-to-end encrypted.",
    "[3/9/26, 9:00:00 AM] - Asha created this group",
    "[3/9/26, 9:00:20 AM] - Asha added Ben",
    "[3/9/26, 9:00:25 AM] - Asha added Chitra",
    "[3/9/26, 9:01:00 AM] Asha: Good morning",
    "[3/9/26, 9:01:30 AM] Ben: Good morning",
    "[3/9/26, 9:02:00 AM] Asha: <image omitted>",
    "[3/9/26, 10:15:00 AM] Chitra: सुप्रभात group",
    "[3/9/26, 11:40:12 PM] Ben: see https://example.com/a?b=1",
    "and a second line",
    "[3/9/26, 11:41:00 PM] Ben: see https://example.com/a?b=2",
    "and a second line",
    "[3/10/26, 12:05:00 AM] Chitra: This message was deleted",
    "[3/10/26, 8:00:00 AM] - Dev joined using an invite link",
    "[3/10/26, 8:01:00 AM] Dev: [Forwarded] call +91 98765 43210 today",
    "[3/10/26, 8:05:00 AM] Asha: Good morning",
    "[3/10/26, 6:30:00 PM] Asha: Rehearsal moves to the big hall, bring your scores",
    "[3/10/26, 6:31:10 PM] Ben: The big hall it is",
    "[3/10/26, 6:33:00 PM] Chitra: Which door is open?",
    "[3/11/26, 7:45:00 AM] Chitra: उद्या तालीम आहे",
    "[3/11/26, 7:46:00 AM] Asha: उद्या rehearsal आहे, do not be late",
    "[3/11/26, 7:50:00 AM] Dev: <video omitted>",
    "[3/11/26, 8:20:00 PM] Dev: <album message>",
    "[3/12/26, 9:15:00 AM] Ben: Two seats left in my car",
    "[3/12/26, 9:16:00 AM] Dev: One for me please",
    "[3/12/26, 9:16:40 AM] Chitra: And one for me",
    "[3/12/26, 1:00:00 PM] - Asha changed this group's settings to allow only admins to send messages",
    "[3/13/26, 4:04:04 PM] Asha: <unknown message>",
    "[3/13/26, 4:05:00 PM] Asha: This message was deleted",
    "[3/13/26, 4:05:00 PM] Asha: This message was deleted",
    "[3/13/26, 5:30:00 PM] Ben: Rehearsal moves to the big hall, bring your scores",
    "[3/14/26, 10:00:00 AM] Asha: Programme for Sunday:",
    "first the old songs,",
    "then the new ones",
    "[3/14/26, 10:02:00 AM] Dev: Good plan",
    "[3/14/26, 11:11:11 AM] - Ben's security code changed. Tap to learn more.",
    "[3/15/26, 5:00:00 PM] Chitra: <image omitted>",
    "[3/15/26, 5:01:00 PM] Ben: What a concert, thanks everyone",
    "[3/15/26, 5:02:00 PM] Dev: Thanks everyone",
    "[3/16/26, 8:08:08 AM] Asha: Good morning",
    "[3/16/26, 8:30:00 AM] Chitra: See you next month",
    "[3/16/26, 8:31:00 AM] Ben: See you next month",
)


def stamp(at):
    """A time as exports write it."""
    return F.date_format(at, "M/d/yy, h:mm:ss a")


def synthetic_lines(spark: SparkSession, n: int, seed: int = 0, senders: int = 3, repeat_every: int = 7) -> DataFrame:
    """chat, line_no, line: n rows on as many tasks as Spark likes. Every repeat_every-th is a template, every 11th media, every 37th deleted."""
    pick = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")
    words = F.array(*map(F.lit, VOCABULARY))
    line = F.array_join(F.transform(F.sequence(F.lit(1), pick("n", 9) + 3), lambda i: F.get(words, F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(VOCABULARY))).cast("int"))), " ")
    said = (
        F.when(F.col("id") % 37 == 36, "This message was deleted")
        .when(F.col("id") % 11 == 10, "<image omitted>")
        .when(F.col("id") % repeat_every == repeat_every - 1, F.get(F.array(*map(F.lit, TEMPLATES)), pick("t", len(TEMPLATES))))
        .otherwise(line)
    )
    who = F.get(F.array(*map(F.lit, NAMES)), pick("who", min(senders, len(NAMES))))
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 211)
    text = F.concat(F.lit("["), stamp(at), F.lit("] "), who, F.lit(": "), said)
    return spark.range(n).select(F.lit("synthetic").alias("chat"), (F.col("id") + 1).alias("line_no"), text.alias("line"))


#: Bodies of the fixture generator by their share in percent; the rest are lines of SAYINGS.
SHARES = (("<image omitted>", 6), ("This message was deleted", 3), ("[Forwarded] the weekly plan: training on Tuesday, match on Sunday", 3), ("more under https://example.com/page?n=", 4), ("my number is +91 90000 12345", 2))
FREQUENT = 4
SAYINGS = (
    "the match begins at four", "who brings the ball", "see you at the station", "thank you all for coming", "the bus leaves at nine sharp", "lunch anyone?", "😀😀", "well done 🎉",
    "उद्या सामना आहे", "धन्यवाद", "कल सब समय पर आना", "आज practice आहे का", "match उद्या at five", "kal milte hain", "ho barobar", "ठीक hai see you",
)
LONG_EVERY = 33


def fixture_lines(spark: SparkSession, n: int, seed: int = 0, senders: tuple[str, ...] = NAMES, days: int = 30, system_events: bool = True, marked: bool = False, phone_sender: str | None = None) -> DataFrame:
    """chat, line_no, line: a made-up group chat with media, deleted, forwarded, linked, phone, many-line and repeated messages, and system rows.

    A message's kind is a hash of its number, so any number of tasks makes the same chat. Every LONG_EVERY-th message has four lines, which keeps line numbers a formula.
    """
    who = senders + ((phone_sender,) if phone_sender else ())
    draw = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")
    roll, start, said = F.col("_roll"), 0, None
    for body, share in SHARES:
        text = F.concat(F.lit(body), draw("page", 5).cast("string")) if body.endswith("=") else F.lit(body)
        holds = (roll >= start) & (roll < start + share)
        said, start = F.when(holds, text) if said is None else said.when(holds, text), start + share
    say = lambda size: F.get(F.array(*map(F.lit, SAYINGS)), draw("say", size))
    said = said.when((roll >= start) & (roll < start + FREQUENT), say(3)).otherwise(say(len(SAYINGS)))
    long = F.col("id") % LONG_EVERY == LONG_EVERY - 1
    step = days * 86_400 // max(n, 1)
    at = F.concat(F.lit("["), stamp(F.timestamp_seconds(F.lit(1_741_564_800) + F.col("id") * step + draw("at", max(step, 1)))), F.lit("] "))
    name = F.get(F.array(*map(F.lit, who)), draw("who", len(who)))
    events = {0: f"- {who[0]} created this group", 1: f"{who[0]} added {who[-1]}", 2: f"- {who[-1]}'s security code changed. Tap to learn more.", n // 3: f"- {who[1 % len(who)]} left", 2 * n // 3: f"{who[0]} changed the group name to “Fictional {seed}”"}
    event = F.lit(None).cast("string")
    for k, e in events.items() if system_events and n > 6 else ():
        event = F.when((F.col("id") == k) & ~long, F.lit(e)).otherwise(event)
    body = F.when(long, F.array(F.concat(name, F.lit(": a note of some lines")), F.lit("the second"), F.lit(""), F.lit("and the last"))).otherwise(F.array(F.coalesce(event, F.concat(name, F.lit(": "), said))))
    front = F.when(F.lit(marked) & event.isNotNull(), F.lit("\u200e")).otherwise(F.lit(""))
    rows = spark.range(n).withColumn("_roll", draw("kind", 100)).select("id", front.alias("_front"), at.alias("_at"), F.posexplode(body).alias("_k", "_said"))
    line = F.when(F.col("_k") == 0, F.concat("_front", "_at", "_said")).otherwise(F.col("_said"))
    number = F.col("id") + 2 + 3 * F.floor(F.col("id") / LONG_EVERY) + F.col("_k")
    header = spark.createDataFrame([("fixture", 1, "Messages and calls are end-to-end encrypted.")], "chat string, line_no long, line string")
    return header.unionByName(rows.select(F.lit("fixture").alias("chat"), number.cast("long").alias("line_no"), line.alias("line")))
