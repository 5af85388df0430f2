"""Provider request bodies, headers and responses derived from
``conversations`` (FIXTURES.md part 3), in the three JSON dialects.

One body per ``conv_id`` (one shuffle: group the turns by conversation).
Dialect by ``conv_id % 3``: 0 OpenAI chat, 1 Anthropic messages, 2 Gemini.
User turns of even conversations get an e-mail address (distinct per turn,
so two messages carry two different addresses) and, every fourth
conversation, an OpenAI-style key.  Content alternates between the string
and the list form; some list parts are images (OpenAI) or tool results
(Anthropic) so every branch of the dialect walkers is exercised.  Every seventh
conversation (``ODD``) also holds shapes that are legal but rarely written: OpenAI
messages with null or no content and a part without a type, an empty Anthropic system
prompt, a Gemini system instruction that is a plain string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.prompt import KEY_HEADER, PROVIDER_HEADER
from veilframe.sources.domain import KEY_PREFIX
from veilframe.sources.tables import load

DIALECTS = ("openai", "anthropic", "gemini")


ODD_SQL = "conv_id % 7 = 3"


def augmented_text(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    secret = F.concat(F.lit(" My key is sk-"),
                      F.substring(F.concat(F.sha2(conv.cast("string"), 256), F.sha2(conv.cast("string"), 256)), 1, 48),
                      F.lit("."))
    extra = F.concat(F.lit(" Contact me at user"), conv.cast("string"), F.lit("."), turn.cast("string"),
                     F.lit("@example.com."), F.when(conv % 4 == 0, secret).otherwise(F.lit("")))
    return F.when((role == "user") & (conv % 2 == 0), F.concat(text, extra)).otherwise(text)


AUGMENTED_TEXT_SQL = """CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN text || ' Contact me at user' || CAST(conv_id AS VARCHAR)
  || '.' || CAST(turn AS VARCHAR) || '@example.com.' ||
  CASE WHEN conv_id % 4 = 0 THEN ' My key is sk-' || substr(sha256(CAST(conv_id AS VARCHAR)) || sha256(CAST(conv_id AS VARCHAR)), 1, 48) || '.' ELSE '' END
  ELSE text END"""


def image_part_json(conv: Column) -> Column:
    return F.concat(F.lit('{"type":"image_url","image_url":{"url":"https://img.example/'), conv.cast("string"),
                    F.lit('.png"}}'))


def tool_part_json(conv: Column, turn: Column) -> Column:
    return F.to_json(F.struct(F.lit("tool_result").alias("type"),
                              F.concat(F.lit("call_"), turn.cast("string")).alias("tool_use_id"),
                              F.concat(F.lit("done "), conv.cast("string")).alias("content")))


def _text_part(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))


def _list_message(role: Column, parts_json: Column) -> Column:
    """``{"role": r, "content": [...]}`` with a list content (roles are plain
    ASCII words, the parts are already JSON)."""
    return F.concat(F.lit('{"role":"'), role, F.lit('","content":'), parts_json, F.lit("}"))


def _message_json(dialect: str, conv: Column, turn: Column, role: Column, text: Column) -> Column:
    if dialect == "openai":
        as_str = F.to_json(F.struct(role.alias("role"), text.alias("content")))
        parts = F.concat(F.lit("["), _text_part(text),
                         F.when(turn % 4 == 1, F.concat(F.lit(","), image_part_json(conv))).otherwise(F.lit("")), F.lit("]"))
        return F.when(turn % 2 == 0, as_str).otherwise(_list_message(role, parts))
    if dialect == "anthropic":
        as_str = F.to_json(F.struct(role.alias("role"), text.alias("content")))
        parts = F.concat(F.lit("["), _text_part(text),
                         F.when(turn % 4 == 3, F.concat(F.lit(","), tool_part_json(conv, turn))).otherwise(F.lit("")),
                         F.lit("]"))
        return F.when(turn % 2 == 0, as_str).otherwise(_list_message(role, parts))
    g_role = F.when(role == "assistant", F.lit("model")).otherwise(role)
    return F.to_json(F.struct(g_role.alias("role"), F.array(F.struct(text.alias("text"))).alias("parts")))


def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, dialect, path, headers (map), body (JSON text)."""
    c = load(spark, sf, "conversations")
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    text = augmented_text(conv, turn, role, F.col("text"))
    dialect_idx = (conv % 3).cast("int")
    rows = c.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                    dialect_idx.alias("d"))
    msg = F.when(F.col("d") == 0, _message_json("openai", conv, turn, role, F.col("text"))) \
           .when(F.col("d") == 1, _message_json("anthropic", conv, turn, role, F.col("text"))) \
           .otherwise(_message_json("gemini", conv, turn, role, F.col("text")))
    rows = rows.withColumn("msg", msg)
    # grouped by conv_id alone (the dialect is a function of it), so that
    # later per-request regroups reuse this hash partitioning
    g = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "msg"))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "msg")))).alias("non_sys"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))
                                  .alias("x")).getField("text"), "\n").alias("system_text"),
        F.count_if(F.col("role") == "system").alias("n_sys")).withColumn("d", (F.col("conv_id") % 3).cast("int"))
    k = F.col("conv_id")
    stream = k % 5 == 0
    odd = F.expr(ODD_SQL)
    odd_msgs = F.concat(F.lit(',{"role":"assistant","content":null},{"role":"user"},{"role":"user","content":[{"text":"untyped '),
                        k.cast("string"), F.lit('"}]}'))
    all_msgs = F.concat(F.lit("["), F.array_join(F.col("all").getField("msg"), ","), F.when(odd, odd_msgs).otherwise(F.lit("")), F.lit("]"))
    chat_msgs = F.concat(F.lit("["), F.array_join(F.col("non_sys").getField("msg"), ","), F.lit("]"))
    # '"system":"..."' : the escaped field taken out of a one-field JSON object
    sys_field = F.regexp_replace(F.to_json(F.struct(F.col("system_text").alias("system"))), r"^\{(.*)\}$", "$1")
    openai_body = F.concat(F.lit('{"model":'), F.when(k % 2 == 0, F.lit('"gpt-4o"')).otherwise(F.lit('"gpt-4o-mini"')),
                           F.lit(',"messages":'), all_msgs, F.lit(',"stream":'),
                           F.when(stream, F.lit("true")).otherwise(F.lit("false")), F.lit("}"))
    anth_body = F.concat(F.lit('{"model":"claude-3-5-sonnet-20241022","max_tokens":256,'),
                         F.when(F.col("n_sys") > 0, F.concat(sys_field, F.lit(",")))
                          .when(odd, F.lit('"system":"",')).otherwise(F.lit("")),
                         F.lit('"messages":'), chat_msgs, F.lit("}"))
    sys_inst = F.to_json(F.struct(F.array(F.struct(F.col("system_text").alias("text"))).alias("parts")))
    gem_body = F.concat(F.lit('{"contents":'), chat_msgs,
                        F.when(F.col("n_sys") > 0, F.concat(F.lit(',"systemInstruction":'), sys_inst))
                         .when(odd, F.lit(',"systemInstruction":"stay brief"')).otherwise(F.lit("")),
                        F.lit("}"))
    body = F.when(F.col("d") == 0, openai_body).when(F.col("d") == 1, anth_body).otherwise(gem_body)
    gem_model = F.when(k % 17 == 0, F.lit("")).otherwise(F.lit("gemini-1.5-pro"))
    gem_path = F.concat(F.lit("/gemini/v1beta/models/"), gem_model,
                        F.when(stream, F.lit(":streamGenerateContent")).otherwise(F.lit(":generateContent")))
    path = (F.when(k % 13 == 0, F.lit("/cohere/v1/chat"))
             .when(F.col("d") == 0, F.lit("/openai/v1/chat/completions"))
             .when(F.col("d") == 1, F.lit("/anthropic/v1/messages")).otherwise(gem_path))
    headers = F.create_map(
        F.lit("Host"), F.lit("localhost"), F.lit("User-Agent"), F.lit("curl"),
        F.lit("Authorization"), F.concat(F.lit("Bearer sk-fake-"), k.cast("string")),
        F.lit(KEY_HEADER), F.lit(KEY_PREFIX + "xyz"), F.lit("OpenAI-Organization"), F.concat(F.lit("org-"), (k % 3).cast("string")),
        F.lit("Anthropic-Version"), F.lit("2023-06-01"),
        F.lit("X-Request-Id"), F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(None).cast("string"))
                                .otherwise(F.concat(F.lit("req-"), k.cast("string"))),
        F.lit(PROVIDER_HEADER), F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.lit("cohere"))
                                   .otherwise(F.element_at(F.array(*[F.lit(d) for d in DIALECTS]), (k % 3 + 1).cast("int"))))
    return g.select("conv_id", F.element_at(F.array(*[F.lit(d) for d in DIALECTS]), (F.col("d") + 1)).alias("dialect"),
                    path.alias("path"), headers.alias("headers"), body.alias("body"))


REPLY = "Reply for conversation {c}: noted <EMAIL_ADDRESS_1>, see <EMAIL_ADDRESS_2> and <PERSON_99>."


def _json_string(s: Column) -> Column:
    return F.to_json(s.cast("variant"))


def reply_text(conv: Column) -> Column:
    return F.concat(F.lit("Reply for conversation "), conv.cast("string"),
                    F.lit(": noted <EMAIL_ADDRESS_1>, see <EMAIL_ADDRESS_2> and <PERSON_99>."))


REPLY_SQL = ("'Reply for conversation ' || CAST(conv_id AS VARCHAR) || "
             "': noted <EMAIL_ADDRESS_1>, see <EMAIL_ADDRESS_2> and <PERSON_99>.'")


def responses(bodies: DataFrame) -> DataFrame:
    """Dialect-shaped response JSON echoing placeholders (one unknown)."""
    k = F.col("conv_id")
    r = reply_text(k)
    # the second choice is what a streamed response would hold: a delta and no message
    message = '"message":{"role":"assistant","content":'
    openai = F.concat(
        F.lit('{"id":"chatcmpl-'), k.cast("string"), F.lit('","object":"chat.completion","created":1700000000,"model":"gpt-4o","choices":[{"index":0,' + message),
        _json_string(r), F.lit('},"finish_reason":"stop"},{"index":1,"message":null,"delta":{"content":'), _json_string(r),
        F.lit('}}],"usage":{"prompt_tokens":10,"completion_tokens":5,"total_tokens":15}}'))
    anth = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), r.alias("text")),
                                      F.struct(F.lit("text").alias("type"), F.lit("Done.").alias("text"))).alias("content")))
    gem = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(r.alias("text"))).alias("parts"))
                                              .alias("content"))).alias("candidates")))
    d = F.col("dialect")
    return bodies.select("conv_id", "dialect",
                         F.when(d == "openai", openai).when(d == "anthropic", anth).otherwise(gem).alias("response"))
