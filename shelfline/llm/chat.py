"""Chat formatting from a declarative template, in DataFrame operations only.

A template has a state machine over roles (which role may follow which), the strings that open and
close a turn, and which roles are trained on. Formatting sorts the turns of a conversation, checks
their order and emits text segments, each with a loss flag. Inside texts, & and < become &amp; and
&lt;, so no text can hold a string of the template, and the output reads back exactly.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `next` maps a state (start, or the last role) to the roles allowed after it; {role} stands for the escaped role.
TEMPLATE = {
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "end": ["user", "assistant"],
    "open": "<|{role}|>\n",
    "close": "<|end|>\n",
    "loss": ["assistant"],
}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def format_chats(rows: DataFrame, template: dict = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, error_at, segments (text, loss), formatted.

    Turns go by number, null numbers first, ties by role and text; null role and text are empty.
    Rows with a null conversation id belong to no conversation and are left out. A conversation whose
    turns break the state machine is formatted like any other, with valid false and error_at the
    place (from 0) of the first turn that may not follow; n_turns if it may not end there, null if valid.
    """
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    moves = F.create_map(*[F.lit(x) for state, after in template["next"].items() for x in (state, list(after))]) if template["next"] else None
    may = lambda state, r: F.coalesce(F.array_contains(moves[state], r), F.lit(False)) if moves is not None else F.lit(False)
    walk = F.aggregate(
        F.transform("t", lambda x: x["role"]),
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error_at")),
        lambda s, r: F.struct(r.alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["error_at"], F.when(~may(s["state"], r), s["at"])).alias("error_at")),
    )
    before, after = template["open"].split("{role}")
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                part(F.concat(F.lit(before), _escape_role(x["role"]), F.lit(after)), F.lit(False)),
                part(escape(x["text"]), x["role"].isin(list(template["loss"]))),
                part(F.lit(template["close"]), F.lit(False)),
            ),
        )
    )
    ended = F.when(~F.col("walk.state").isin(list(template["end"])), F.size("t"))
    out = talks.select("conv_id", "t", walk.alias("walk"), segments.alias("segments"))
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.coalesce("walk.error_at", ended).alias("error_at"), "segments").select(
        "conv_id", "n_turns", F.col("error_at").isNull().alias("valid"), "error_at", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted conversation: array of struct (role, text)."""
    before, after = template["open"].split("{role}")
    literal = lambda s: "\\Q" + s + "\\E"
    parts = F.split(formatted, literal(template["close"]), -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, after, 1)
        return F.struct(unescape(F.substring(head, F.lit(len(before) + 1), F.length(head))).alias("role"), unescape(F.substring(p, F.length(head) + len(after) + 1, F.length(p))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    chats = format_chats(given.unionByName(extra))
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = chats.select("conv_id", read_back(F.col("formatted")).alias("back"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    digest = F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "valid")


OP8_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role, 1, 'start') OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    AND (place < n OR role IN ('user', 'assistant'))) AS valid
FROM placed GROUP BY conv_id
"""
