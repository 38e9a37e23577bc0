"""Attributes and specification lines as ordered folds over the text nodes that the mapper hands over.

Both rules are sequential: whether a row becomes a pair depends on the keys before it, and where a value
ends depends on the labels after it. Each is one ``aggregate`` per page over an array of nodes, with the keys
so far, or the open label, as its state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from shelfmark import fixed_values as fixed
from shelfmark.functions.text import strip

_TEXTS = "array<string>"


@dataclass(frozen=True)
class SpecLimits:
    """Where specification texts are cut; None is no limit. ``SpecLimits()`` cuts nothing."""

    #: Code points of a script after its first mark, and whether a second mark ends it.
    window: int | None = None
    until_next_mark: bool = False
    #: Scripts that are read, in page order.
    scripts: int | None = None
    #: A label has fewer code points than this, and more than ``label_above``.
    label_below: int | None = None
    label_above: int = fixed.SPEC_LABEL_ABOVE
    #: Texts that may follow a label, and code points of a value after which it ends.
    lookahead: int | None = None
    value_stop: int | None = None
    #: Code points before the mark, so that its own tag is whole.
    before: int = fixed.SPEC_BEFORE
    mark: str = fixed.SPEC_ANCHOR
    noise: tuple[str, ...] = tuple(fixed.SPEC_NOISE)


#: The limits of the product contract.
CONTRACT_LIMITS = SpecLimits(window=fixed.SPEC_WINDOW, until_next_mark=True, scripts=1, label_below=fixed.SPEC_LABEL_BELOW,
                             lookahead=fixed.SPEC_LOOKAHEAD, value_stop=fixed.SPEC_VALUE_STOP)


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _without(text: Column, label: Column) -> Column:
    """Text minus the first occurrence of a label in it."""
    at = F.position(label, text)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(label), F.length(text)))


def block_content(block: Column) -> Column:
    """struct(keys, values, rest) of a block's nodes (kind, label, text).

    A ``pair`` node is a ready pair; of a ``row`` node the label and the text behind it are tried first,
    then the text cut at its first colon; what becomes no pair, and every ``text`` node, is free text. The
    first value of a key stays.
    """
    def node(e: Column) -> Column:
        colon = F.position(F.lit(":"), e["text"])
        row, cut = e["kind"] == "row", (e["kind"] == "row") & (colon > 0)
        return F.struct(
            (e["kind"] == "pair").alias("pair"), e["label"].alias("label"), e["text"].alias("text"),
            F.when(row & (e["label"] != ""), strip(_without(e["text"], e["label"]))).otherwise("").alias("value"),
            F.when(cut, strip(F.substring(e["text"], F.lit(1), colon - 1))).otherwise("").alias("key"),
            F.when(cut, strip(F.substring(e["text"], colon + 1, F.length(e["text"])))).otherwise("").alias("said"))

    def state(keys: Column, values: Column, rest: Column) -> Column:
        return F.struct(keys.alias("keys"), values.alias("values"), rest.alias("rest"))

    def step(s: Column, e: Column) -> Column:
        def fresh(key: Column, value: Column) -> Column:
            return (key != "") & (value != "") & ~F.array_contains(s["keys"], key)

        def put(key: Column, value: Column) -> Column:
            return state(F.concat(s["keys"], F.array(key)), F.concat(s["values"], F.array(value)), s["rest"])
        return (F.when(e["pair"], F.when(fresh(e["label"], e["text"]), put(e["label"], e["text"])).otherwise(s))
                .when(fresh(e["label"], e["value"]), put(e["label"], e["value"]))
                .when(fresh(e["key"], e["said"]), put(e["key"], e["said"]))
                .otherwise(state(s["keys"], s["values"], F.concat(s["rest"], F.array(e["text"])))))

    return F.aggregate(F.transform(block, node), state(_none(), _none(), _none()), step)


def attribute_pairs(content: Column) -> Column:
    """array<struct<key,value>> in page order."""
    return F.zip_with(content["keys"], content["values"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def free_text(content: Column) -> Column:
    return F.filter(F.array_distinct(content["rest"]), lambda t: t != "")


def spec_lines(scripts: Column, limits: SpecLimits = CONTRACT_LIMITS) -> Column:
    """``label: value`` lines from the text nodes of each script.

    A label is a text with a colon that is not noise and not a label before; texts behind it are its value
    until the next text with a colon.
    """
    def node(t: Column) -> Column:
        noisy = F.lit(False)
        for word in limits.noise:
            noisy = noisy | F.contains(t, F.lit(word))
        head = F.contains(t, F.lit(":"))
        if limits.label_below is not None:
            head = head & (F.length(t) < limits.label_below)
        return F.struct(t.alias("t"), noisy.alias("noisy"), head.alias("head"),
                        strip(F.replace(t, F.lit(":"), F.lit(""))).alias("label"))

    def state(s: Column, label: Column, parts: Column, seen: Column) -> Column:
        return F.struct(s["labels"].alias("labels"), s["lines"].alias("lines"), label.alias("label"),
                        parts.alias("parts"), seen.alias("seen"))

    def closed(s: Column) -> Column:
        """The open label and its value become a line, if it has one."""
        kept = s["label"].isNotNull() & (F.size(s["parts"]) > 0)
        line = F.concat(s["label"], F.lit(": "), F.array_join(s["parts"], " "))
        return F.struct(
            F.when(kept, F.concat(s["labels"], F.array(s["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(kept, F.concat(s["lines"], F.array(line))).otherwise(s["lines"]).alias("lines"),
            F.lit(None).cast("string").alias("label"), _none().alias("parts"), F.lit(0).alias("seen"))

    def step(s: Column, e: Column) -> Column:
        takes = s["label"].isNotNull() & ~e["head"]
        if limits.lookahead is not None:
            takes = takes & (s["seen"] < limits.lookahead)
        taken = state(s, s["label"], F.when(e["noisy"], s["parts"]).otherwise(
            F.concat(s["parts"], F.array(e["t"]))), s["seen"] + 1)
        if limits.value_stop is not None:
            taken = F.transform(F.array(taken), lambda x: F.when(
                ~e["noisy"] & (F.length(F.array_join(x["parts"], " ")) > limits.value_stop), closed(x)).otherwise(x))[0]
        opened = F.transform(F.array(closed(s)), lambda x: F.when(
            e["head"] & ~e["noisy"] & (F.length(e["label"]) > limits.label_above)
            & ~F.array_contains(x["labels"], e["label"]), state(x, e["label"], _none(), F.lit(0))).otherwise(x))[0]
        return F.when(takes, taken).otherwise(opened)

    start = F.struct(_none().alias("labels"), _none().alias("lines"), F.lit(None).cast("string").alias("label"),
                     _none().alias("parts"), F.lit(0).alias("seen"))
    return F.array_distinct(F.flatten(F.transform(scripts, lambda texts: F.aggregate(
        F.transform(texts, node), start, step, lambda s: closed(s)["lines"]))))
