"""The stateful cascade as a stream: analysis and scoring are projections, a conversation's state is kept by key.

State holds the decayed sums, the live fragments and the last messages, a bounded number of each; what a re-scan joins comes out of it and is analysed by
projections again. Strikes and cooldowns, which never feed back, are counted downstream. Rows of a batch are put in order of time
within their conversation; messages later than the watermark are dropped. State without messages for longer than it matters is timed out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saltmarsh.config import RiskConfig
from saltmarsh.functions import score
from saltmarsh.operators import moderate, session, stateful

STATE = "json string"
OUT = "message_id string, digit_pressure double, session_intent double, merged string, rescan_text string, seen array<string>, payload string"


def advance(state: dict, ms: int, sender: str, digits: list[str], pressure: float, intents: float, config: RiskConfig, text: str | None = None, types: list[str] = ()) -> tuple[dict, dict]:
    """The state after a message, and what the message sees: sums decayed to its time, a number that it completes, the text to be scanned
    again, and the types that its sender's remembered messages had."""
    half = config.session["digitPressureHalfLifeMs"]
    fade = 0.5 ** (max(0, ms - state.get("ms", ms)) / half)
    seen = {"digit_pressure": state.get("pressure", 0.0) * fade, "session_intent": state.get("intents", 0.0) * fade}
    buffer, number = session.merge_step(
        [tuple(f) for f in state.get("fragments", [])], ms, sender, digits, window_ms=config.session["fragmentWindowMs"], most=config.session["fragmentBufferSize"]
    )
    last = state.get("last", [])
    own = [m for m in last if m[0] == sender]
    seen["rescan_text"] = " ".join(t for t in [*[m[1] for m in own[-config.session["windowedRescanMessages"] :]], text] if t is not None) if own else None
    seen["seen"] = sorted({t for m in own for t in m[2]})
    last = [*last, [sender, text, list(types)]][-config.session["lastMessagesSize"] :]
    now = {"ms": max(ms, state.get("ms", ms)), "pressure": seen["digit_pressure"] + pressure, "intents": seen["session_intent"] + intents, "fragments": buffer, "last": last}
    return now, seen | {"merged": number}


def moderated(messages: DataFrame, config: RiskConfig | None = None, *, watermark: str = "30 minutes", ascii_only: bool = False) -> DataFrame:
    """Verdicts of a stream of messages (message_id and conversation_id strings, ts a timestamp)."""
    config = config or RiskConfig()
    df = moderate.analysed(messages.withWatermark("ts", watermark), config, ascii_only=ascii_only)
    loose = session.fragments(F.col("runs"), F.col("denoised"), F.col("detections"), config.compat)
    carried = ["text", "folded", "detections", "runs", "zero_width", "confusables", "noise", "booking_stage", "sender_role"]
    slim = df.select(
        "message_id", "conversation_id", "sender_role", F.unix_millis("ts").alias("ms"), loose.alias("fragments"), session.pressure().cast("double").alias("pressure"),
        session.intent_hits().cast("double").alias("intents"), "text", session.kinds(F.col("detections")).alias("types"), "ts", F.to_json(F.struct(*carried)).alias("payload"),
    )
    idle = max(config.session["fragmentWindowMs"], 10 * config.session["digitPressureHalfLifeMs"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ms", "message_id"])
        out = []
        for r in rows.itertuples(index=False):
            held, seen = advance(held, int(r.ms), r.sender_role, list(r.fragments), r.pressure, r.intents, config, r.text, list(r.types))
            out.append((r.message_id, seen["digit_pressure"], seen["session_intent"], seen["merged"], seen["rescan_text"], seen["seen"], r.payload))
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(out, columns=["message_id", "digit_pressure", "session_intent", "merged", "rescan_text", "seen", "payload"])

    kept = slim.groupBy("conversation_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    payload = df.select(F.struct(*carried).alias("p")).schema["p"].dataType
    rows = kept.withColumn("p", F.from_json("payload", payload)).select("message_id", "digit_pressure", "session_intent", "merged", "rescan_text", "seen", "p.*")
    # the joined texts are analysed like messages; those that need no second look have none
    again = F.when(F.col("rescan_text").isNotNull() & (F.size("runs") > 0), F.col("rescan_text"))
    mine = F.struct(*[F.col(c) for c in rows.columns]).alias("own")
    joint = moderate.analysed(rows.select(mine, again.alias("text")), config, ascii_only=ascii_only).select("own", F.col("detections").alias("joint"))
    rows = joint.select("own.*", "joint")
    cross = F.coalesce(session.recovered(F.col("joint"), F.col("detections")), F.array().cast(dict(rows.dtypes)["detections"]))
    rows = rows.withColumn("cross", cross).withColumn("evidence", F.concat("detections", "cross"))
    rows = stateful.completed(score.with_score(rows, config, detections="evidence"), config)
    rows = rows.withColumn("cross_message_categories", session.kinds(F.col("cross"))).drop("joint", "cross", "evidence")
    return score.with_verdict(rows, config)
