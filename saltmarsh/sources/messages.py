"""Where messages come from and go to: schemas, JSON lines, validation, and a deterministic synthesiser over the orders table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_id string, conversation_id string, sender_role string, booking_stage string, text string, mode string, ts timestamp"
LABELLED = "id string, text string, category string, technique string, kind string, label string, conversation struct<id:string,turn:int,sender:string>, stage string, sender string, note string"
MINED = "text string, folded string, technique string, why string, source string, minedAt string"
LONGEST = 8000


def read_jsonl(spark: SparkSession, path: str, schema: str = MESSAGE, *, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are dropped. Malformed ones are an error if strict, else left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def stream(spark: SparkSession, path: str, schema: str = MESSAGE) -> DataFrame:
    """Messages as files of JSON lines arrive."""
    return spark.readStream.schema(schema).json(path)


def reject_reason() -> Column:
    """Why a request isn't valid; null if it is. The first failure counts. Lengths are in code points."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("message_id"), "message_id is required").when(blank("conversation_id"), "conversation_id is required")
        .when(F.col("text").isNull(), "text is required").when(F.length("text") > LONGEST, f"text exceeds {LONGEST} characters")
        .when(~F.coalesce(F.col("sender_role").isin("guest", "host"), F.lit(False)), "sender_role is unknown")
        .when(~F.coalesce(F.col("booking_stage").isin("pre_booking", "post_booking"), F.lit(False)), "booking_stage is unknown")
        .when(~F.coalesce(F.col("mode"), F.lit("sync")).isin("sync", "async"), "mode is unknown")
    )


def validated(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid messages, and the others with their reason."""
    judged = messages.withColumn("reason", reject_reason())
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


#: Messages that one task judges, about.
ROWS_A_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, and over more tasks the more rows there are. How many parts a file is read in says little, as whole row groups may lie in
    a few of them and none in the others; and judging a message costs far more than moving it. df is read twice."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_A_TASK)))


def synthetic(orders: DataFrame) -> DataFrame:
    """One message for each order, by arithmetic on its key. Templates: a mobile, a price, a payment handle, thanks, an email
    address, a messenger link, an insult, a house number."""
    key = F.col("o_orderkey")
    mobile = (F.lit(6_000_000_000) + (key * 7919) % 3_999_999_999).cast("string")
    texts = [
        F.concat(F.lit("call me on "), mobile), F.concat(F.lit("the price is "), (key % 9000 + 1000).cast("string"), F.lit(" per night for 2 guests")),
        F.concat(F.lit("pay me on user"), key.cast("string"), F.lit("@okaxis")), F.lit("thanks see you soon"),
        F.concat(F.lit("write to guest"), key.cast("string"), F.lit("@gmail.com")), F.concat(F.lit("see wa.me/91"), mobile), F.lit("you stupid clown"),
        F.lit("house no 4 near the temple"),
    ]
    text = F.element_at(F.array(*texts), (key % len(texts) + 1).cast("int"))
    return orders.select(
        key.alias("message_id"), F.col("o_custkey").alias("conversation_id"), F.when(F.floor(key / 8) % 2 == 0, "guest").otherwise("host").alias("sender_role"),
        F.when(F.floor(key / 8) % 5 == 0, "post_booking").otherwise("pre_booking").alias("booking_stage"), text.alias("text"), F.lit(None).cast("string").alias("mode"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns of users and assistants as guests' and hosts' messages, a minute apart."""
    role = F.when(F.col("role") == "user", "guest").when(F.col("role") == "assistant", "host")
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").cast("string").alias("conversation_id"),
        role.alias("sender_role"), F.lit("pre_booking").alias("booking_stage"), "text", F.lit(None).cast("string").alias("mode"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"),
    )


#: Texts for each technique and each innocent look-alike. <m> is a mobile made of the order's key, <s> it with blanks, <w> and <h> it in words,
#: <v> with invisible characters, <f> in wide digits, <n> its nine last digits, <5> five, <t> its last five, <4> four of them, <k> the key.
TECHNIQUES = [
    "call me on <m>", "my number is <s>", "reach me at <w>", "mera number <h>", "call me on <v> ok", "find me on <f> please", "c1all m22e on <m> now", "wh4t5app me on <m>",
    "whаtsapp me оn <m>", "ﬁrst call Straße <m>", "ring +91<m>!", "ring (<5>) (<n>)", "<4>-<5>-<k>", "double <4> triple 9 <5> five4", "to do for no one", "nine one two to <5>",
    "booking ref 20260115<4> please", "call 4420<n>", "<5> only", "the total is ₹98,<4> for 5 nights", "the pin code is 4<5>", "i left my iPhone 15 Pro, 256GB there", "flight AI<4> lands at 9 am", "we are 2 guests and 3 kids",
    "write to guest<k>@gmail.com", "mail john.doe<k> at gmail dot com", "john<k> (at) proton [dot] me", "a.b@c<k>.co.in ok", "pay me on user<k>@okaxis", "pay <m>@ybl now", "pay x<k>@okaxis.com", "not@<k>",
    "see wa.me/91<m>", "instagram dot com slash me<k>", "look at bit.ly/x<k>", "pay at paypal.me/u<k>", "go to deal<k>.xyz", "our site villa<k>.com/rooms", "gооgle<k>.com is it", "t.me/user<k> or x.com",
    "insta: some_one<k>", "insta id is the", "follow @some.one<k> or @a.com", "telegram me <4> ok", "same handle as my name on insta", "signal user: abc<4>z", "whatsapp <w>", "the gate code is <4>",
    "here is the address near gate code <4>", "what is the exact address", "share location and live location pin", "book direct with me", "let us chat on whatsapp", "someone asked me to chat on whatsapp", "call me or google pay me",
    "find me on insta and dm me on telegram", "let us call it a day, call me", "book direct flights to <k>", "send me your number please", "you stupid clown", "we had a shitty flight", "you are such a damn idiot", "f*ck off you b*tch",
    "refund me or else i leave a bad review", "refund me, the 1 star is written", "otherwise i report you", "give me a refund please", "pay the deposit urgently at secure<k>.xyz", "urgent: free gift at win<k>.click, hurry", "thanks see you soon",
    "someone contacted me on whatsapp asking for my number <m>", "c4ll me 0n wh4tsapp", "is breakfast included", "",
    "<5>", "<t>", "thanks, see you", "digits <5>", "then <t> ok",
]
WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
HINDI = ["shunya", "ek", "do", "teen", "chaar", "paanch", "chhe", "saat", "aath", "nau"]


def techniques(orders: DataFrame) -> DataFrame:
    """One message for each order, by arithmetic on its key, over all of TECHNIQUES."""
    key = F.col("o_orderkey")
    mobile = (F.lit(6_000_000_000) + (key * 7919) % 3_999_999_999).cast("string")
    spaced = F.regexp_replace(mobile, "(?<=.)(?=.)", " ")
    said = lambda words: F.array_join(F.transform(F.split(spaced, " "), lambda d: F.element_at(F.array(*map(F.lit, words)), d.cast("int") + 1)), " ")
    made = {
        "m": mobile, "s": spaced, "w": said(WORDS), "h": said(HINDI), "v": F.regexp_replace(mobile, "(?<=.)(?=.)", "​"), "f": F.translate(mobile, "0123456789", "０１２３４５６７８９"),
        "n": F.substring(mobile, 2, 9), "5": F.substring(mobile, 1, 5), "t": F.substring(mobile, 6, 5), "4": F.substring(mobile, 7, 4), "k": key.cast("string"),
    }
    text = F.element_at(F.array(*map(F.lit, TECHNIQUES)), (key % len(TECHNIQUES) + 1).cast("int"))
    for name, value in made.items():
        text = F.replace(text, F.lit(f"<{name}>"), value)
    return orders.select(
        key.alias("message_id"), (F.floor(key / 96)).alias("conversation_id"), F.when(F.floor(key / 8) % 2 == 0, "guest").otherwise("host").alias("sender_role"),
        F.when(F.floor(key / 8) % 5 == 0, "post_booking").otherwise("pre_booking").alias("booking_stage"), text.alias("text"), F.lit(None).cast("string").alias("mode"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key * 300).alias("ts"),
    )
