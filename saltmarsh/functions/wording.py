"""What a person is told of a verdict: labels, tones and one short sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A category's beginning and what is said of it, the first that fits; and labels of verdicts.
SENTENCES = {
    "contact.phone": "A phone number seems to be in it",
    "contact.email": "An email address seems to be in it",
    "contact.handle": "An account on another service seems to be in it",
    "contact.url.messenger": "A link leads to a messenger",
    "contact.url.shortener": "A short link hides where it leads",
    "contact.url.homograph": "A link mixes letters that look alike",
    "contact.url": "There is a link in it",
    "payment.upi": "A payment address seems to be in it",
    "intent.offplatform": "It proposes to go on elsewhere",
    "intent.channel": "It names another chat service",
    "intent.contact": "It asks for or offers a way to get in touch",
    "intent.payment": "It speaks of paying elsewhere",
    "safety.hostility": "Its wording is hostile",
    "safety.extortion": "It ties a review or report to a demand",
    "safety.scamlink": "A link stands beside words of haste or payment",
}
LABELS = {"allow": "Delivered", "warn": "Delivered, with a note", "mask": "Delivered in part", "block": "Held back", "review": "Being checked"}
# Tones of verdicts.
TONES = {"allow": "good", "warn": "caution", "mask": "caution", "review": "caution"}


def sentence(category: Column) -> Column:
    out = category
    for start, words in reversed(SENTENCES.items()):
        out = F.when(category.startswith(start), words).otherwise(out)
    return out


def label(verdict: Column) -> Column:
    out = verdict
    for name, words in LABELS.items():
        out = F.when(verdict == name, words).otherwise(out)
    return out


def tone(verdict: Column) -> Column:
    out = F.lit("stop")
    for name, word in TONES.items():
        out = F.when(verdict == name, word).otherwise(out)
    return out


def summary(categories: Column, verdict: Column) -> Column:
    first, more = sentence(F.get(categories, F.lit(0))), F.size(categories) - 1
    some = F.when(more > 0, F.concat(first, F.lit(", and "), more.cast("string"), F.lit(" more."))).otherwise(F.concat(first, F.lit(".")))
    return F.when(verdict == "allow", "Nothing found.").when(F.size(categories) == 0, "The score alone is high.").otherwise(some)
