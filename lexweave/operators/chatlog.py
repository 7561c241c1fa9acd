"""Relational operators on users, sessions, conversations and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.context import ordered


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


MESSAGE = {"id": "bigint", "conversation_id": "bigint", "role": "string", "content": "string", "thinking": "string", "sections": "string", "rating": "int", "created_at": "timestamp"}


def migrated(messages: DataFrame) -> DataFrame:
    """messages with all columns of the present schema; those that an older table lacks are null."""
    have = set(messages.columns)
    return messages.select(*((F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in MESSAGE.items()))


def added(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages and new ones, whose ids go on after the largest in the order of their created_at."""
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    nth = F.row_number().over(Window.orderBy("created_at", "conversation_id", "content"))  # one batch of new messages
    return migrated(messages).unionByName(migrated(new.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + nth)))


def renamed(conversations: DataFrame, conversation_id: int, user_id: int, title: str) -> DataFrame:
    """conversations with a new title for one, if it is this user's."""
    mine = (F.col("id") == conversation_id) & (F.col("user_id") == user_id)
    return conversations.withColumn("title", F.when(mine, title).otherwise(F.col("title")))


def logged_out(sessions: DataFrame, token: str) -> DataFrame:
    return sessions.where(F.col("token") != token)


def find_user(users: DataFrame, name: str) -> DataFrame:
    """Users whose name or email is this, A-Z in either case."""
    want = lower_ascii(F.lit(name))
    return users.where((lower_ascii(F.col("username")) == want) | (lower_ascii(F.col("email")) == want))


def session_user(sessions: DataFrame, users: DataFrame, bearer: Column | None = None) -> DataFrame:
    """Sessions with their users; bearer: keep the one whose token an authorization header carries."""
    out = sessions.join(users, "user_id")
    return out if bearer is None else out.where(F.when(bearer.startswith("Bearer "), F.substr(bearer, F.lit(8))) == F.col("token"))


def list_conversations(conversations: DataFrame, user_id: int) -> DataFrame:
    return conversations.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "id")


def owned(conversations: DataFrame, conversation_id: int, user_id: int) -> DataFrame:
    return conversations.where((F.col("id") == conversation_id) & (F.col("user_id") == user_id))


def list_messages(messages: DataFrame) -> DataFrame:
    """Messages in order, their JSON columns as arrays (null or empty: an empty array)."""
    arr = lambda c, t: F.coalesce(F.from_json(F.nullif(c, F.lit("")), t), F.array().cast(t))
    section = "array<struct<type:string,number:string,law:string,full_reference:string,relevance:double>>"
    return messages.withColumns({"thinking": arr(F.col("thinking"), "array<string>"), "sections": arr(F.col("sections"), section)}).orderBy("conversation_id", "id")


def rating_stats(messages: DataFrame) -> DataFrame:
    """(rated, average): the number of ratings and their mean to two places."""
    return messages.agg(F.count("rating").alias("rated"), F.round(F.avg("rating"), 2).alias("average"))


def rating_histogram(messages: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """(rating, n) for every rating, zero where none was given."""
    every = messages.sparkSession.range(least, most + 1).select(F.col("id").cast("int").alias("rating"))
    given = messages.where("rating IS NOT NULL").groupBy("rating").agg(F.count("*").alias("n"))
    return every.join(given, "rating", "left").select("rating", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def set_rating(messages: DataFrame, conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """messages after changes (message_id, user_id, rating 1-5): only of assistant messages in the user's own conversations."""
    mine = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id").alias("_owner"))
    ok = changes.where("rating BETWEEN 1 AND 5").join(messages.where("role = 'assistant'").select(F.col("id").alias("message_id"), "conversation_id"), "message_id").join(mine, "conversation_id").where("_owner = user_id")
    new = ok.groupBy(F.col("message_id").alias("id")).agg(F.max("rating").alias("_new"))
    return messages.join(new, "id", "left").withColumn("rating", F.coalesce("_new", "rating")).drop("_new")


def with_updated_at(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations whose updated_at is that of their last message, if later."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_last"))
    return conversations.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations and messages without those of gone (id, user_id); messages go with their conversation."""
    dead = conversations.join(gone.select("id", "user_id"), ["id", "user_id"], "left_semi").select("id")
    return conversations.join(dead, "id", "left_anti"), messages.join(dead.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def violations(messages: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """(rule, n): rows that break each constraint."""
    role = messages.where("role NOT IN ('user', 'assistant')")
    rating = messages.where("rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5")
    orphan = messages.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")
    twice = users.groupBy(lower_ascii(F.col("username")).alias("u")).count().where("count > 1")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in (("message_role", role), ("message_rating", rating), ("message_conversation", orphan), ("user_name", twice))]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def search_titles(conversations: DataFrame, text: str) -> DataFrame:
    return conversations.where(F.contains(F.lower("title"), F.lit(text.lower())))


def date_label(at: Column, now: Column) -> Column:
    """Today, Yesterday, the weekday within seven days, else month and day."""
    days = F.datediff(now, at)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(at > now - F.expr("interval 7 days"), F.date_format(at, "E")).otherwise(F.date_format(at, "MMM d"))


def right_to_left(language: Column, text: Column) -> Column:
    """By the language if it is known, else if any letter is of Arabic script."""
    from lexweave.plans.query_plan import ARABIC

    return F.when(language == "ur", True).when(language == "en", False).otherwise(F.coalesce(text.rlike(ARABIC), F.lit(False)))


def sse_encode(event: Column) -> Column:
    """A struct as one server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def sse_decode(raw: Column, schema: str = "type string, content string") -> Column:
    """The struct of an event; null if it is malformed."""
    return F.when(raw.startswith("data: "), F.from_json(F.trim(F.regexp_replace(raw, r"(?s)^data: |\n+$", "")), schema))


def fold_events(events: DataFrame) -> DataFrame:
    """(conversation_id, answer, thinking, sections) of events (conversation_id, seq, type, content).

    Answer parts joined in order, thinking steps in order, the last sections; conversations whose
    answer is blank are left out.
    """
    of = lambda kind: F.when(F.col("type") == kind, F.coalesce("content", F.lit("")))
    out = events.groupBy("conversation_id").agg(
        F.trim(ordered(of("answer"), "seq", "")).alias("answer"),
        ordered(of("thinking"), "seq", "\n").alias("thinking"),
        F.max_by(of("sections"), F.when(F.col("type") == "sections", F.col("seq"))).alias("sections"),
    )
    return out.where("answer <> ''")

