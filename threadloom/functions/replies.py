"""What a language model's replies say, as columns: every parser has a defined result for empty and broken replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.json_repair import parsed

FALLBACK = "Unclassified"  # fixed value: name of the class that takes what a reply does not place
FACT = "\n[Inferred] "  # fixed value: what stands before inferred facts
ATTRIBUTE = "struct<description:string,value:string,occurred:string,recorded_at:string>"
OPERATIONS, FUNCTIONS = "map<string,struct<description:string>>", "array<struct<class_id:string,instance_id:string,content:string>>"
INSTANCE = f"struct<instance_name:string,attributes:map<string,{ATTRIBUTE}>,operations:{OPERATIONS},functions:{FUNCTIONS},message_labels:array<string>,uninstance_field:string>"


def content(reply: Column) -> Column:
    """The text of a reply: of an object its ``content``, of a list of parts their ``text`` one after the other, else itself."""
    inner = F.when(F.try_parse_json(reply).isNotNull(), F.get_json_object(reply, "$.content"))
    parts = F.from_json(F.when(F.ltrim(inner).startswith("["), inner), "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(joined, inner, reply, F.lit(""))


def new_classes(reply: Column) -> Column:
    """L1: classes that a reply opens, with the labels they take; null if it cannot be read, and classes without a name are left out."""
    got = F.from_json(parsed(reply), "new_classes array<struct<class_name:string,related_message:array<struct<label:bigint>>>>")
    named = F.filter(F.coalesce(got["new_classes"], F.array()), lambda c: F.coalesce(c["class_name"], F.lit("")) != "")
    return F.when(got.isNotNull() & F.get_json_object(parsed(reply), "$").isNotNull(), F.transform(named, lambda c: F.struct(c["class_name"].alias("class_name"), F.transform(F.coalesce(c["related_message"], F.array()), lambda m: m["label"]).alias("labels"))))


def instances(reply: Column) -> Column:
    """Instances of a reply in any of three shapes: a list, an object whose ``instances`` is a list, or one object with a name or attributes.

    Elements of a list that are no objects are left out; an object without fields is no instance at all; null if a reply is none of these.
    """
    text = parsed(reply)
    objects = lambda c: F.transform(F.filter(F.from_json(c, "array<string>"), lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, INSTANCE))
    listed = objects(F.when(F.ltrim(text).startswith("["), text))
    whole = F.when(F.ltrim(text).startswith("{"), text)
    keys, held = F.json_object_keys(whole), F.get_json_object(whole, "$.instances")
    none = F.array().cast(f"array<{INSTANCE}>")
    one = F.when(F.array_contains(keys, "instance_name") | F.array_contains(keys, "attributes"), F.array(F.from_json(whole, INSTANCE)))
    return F.coalesce(listed, F.when(F.size(keys) == 0, none), objects(F.when(F.ltrim(held).startswith("["), held)), one)


def text_instance(class_name: Column, messages: Column, context: Column) -> Column:
    """L2's fallback and L19: an instance of texts alone."""
    lines = F.array_join(F.concat(F.coalesce(context, F.array().cast("array<string>")), messages), "\n")
    return F.struct(F.concat(class_name, F.lit(" instance")).alias("instance_name"), F.lit(None).alias("attributes"), F.lit(None).alias("operations"), F.lit(None).alias("functions"), F.lit(None).alias("message_labels"), lines.alias("uninstance_field")).cast(INSTANCE)


def updated(have: Column, reply: Column, messages: Column, labels: Column) -> Column:
    """L3, B2: an instance after a reply that was asked to update it with new messages: the first instance of the reply, whose name is kept where it gives none, else the instance with its text grown by the messages; labels are merged either way."""
    new = F.try_element_at(instances(reply), F.lit(1))
    merged = F.array_distinct(F.concat(F.coalesce(have["message_labels"], F.array().cast("array<string>")), F.transform(labels, lambda x: F.trim(x.cast("string")))))
    pick = lambda name, other: F.when(new.isNotNull(), F.coalesce(new[name], have[name])).otherwise(other).alias(name)
    text = pick("uninstance_field", updated_text(have["uninstance_field"], messages))
    return F.struct(pick("instance_name", have["instance_name"]), pick("attributes", have["attributes"]), pick("operations", have["operations"]), have["functions"].alias("functions"), merged.alias("message_labels"), text).cast(INSTANCE)


def updated_text(have: Column, messages: Column) -> Column:
    """An instance's text with new messages after it."""
    new = F.array_join(messages, "\n")
    return F.when(F.coalesce(have, F.lit("")) == "", new).otherwise(F.trim(F.concat_ws("\n", have, new)))


def with_facts(text: Column, reply: Column) -> Column:
    """L4: a text with the facts that a reply infers, if there are any."""
    facts = F.filter(F.coalesce(F.from_json(parsed(reply), "facts array<string>")["facts"], F.array()), lambda f: F.trim(F.coalesce(f, F.lit(""))) != "")
    return F.when(F.size(facts) > 0, F.concat(text, F.lit(FACT), F.array_join(facts, " | "))).otherwise(text)


def picks(reply: Column, allowed: Column, field: str, most: int = 10) -> Column:
    """Different ids of a reply's ``field`` that were offered, in order, ``most`` at most; none if it cannot be read."""
    got = F.from_json(parsed(reply), f"{field} array<string>")[field]
    return F.slice(F.array_distinct(F.filter(F.coalesce(got, F.array()), lambda x: F.array_contains(allowed, x))), 1, most)


def answer(reply: Column) -> Column:
    """The ``response`` of a reply, else an empty text."""
    return F.coalesce(F.get_json_object(parsed(reply), "$.response"), F.lit(""))


def decided(reply: Column) -> Column:
    """Whether a batch's reply has a list of decisions."""
    return F.coalesce(F.from_json(parsed(reply), "decisions array<struct<index:string,relation:string>>")["decisions"].isNotNull(), F.lit(False))


def relation(reply: Column, index: Column, u: Column, v: Column) -> Column:
    """The directed pair that a batch's reply states for its pair (u, v) with number ``index``: the last decision with that number counts, null for none, for anything else and for a reply without decisions."""
    got = F.from_json(parsed(reply), "decisions array<struct<index:string,relation:string>>")["decisions"]
    said = F.try_element_at(F.filter(got, lambda d: d["index"].try_cast("int") == index), F.lit(-1))["relation"]
    return F.when(said == "u_before_v", F.struct(u.alias("src"), v.alias("dst"))).when(said == "v_before_u", F.struct(v.alias("src"), u.alias("dst")))


def conflicts(reply: Column) -> Column:
    """Reason and message labels of each conflict a reply reports; none if it says there is none or cannot be read."""
    got = F.from_json(parsed(reply), "is_conflict boolean, conflicts array<struct<conflict_reason:string,conflict_message_labels:array<string>>>")
    return F.when(got["is_conflict"], F.coalesce(got["conflicts"], F.array())).otherwise(F.array().cast("array<struct<conflict_reason:string,conflict_message_labels:array<string>>>"))


def matched(reply: Column) -> Column:
    """Whether a reply says that two statements match: a field ``match`` that is true, else a text that is yes or true alone."""
    field = F.get_json_object(F.when(F.try_parse_json(reply).isNotNull(), reply), "$.match")
    return F.coalesce(F.lower(field) == "true", F.lower(F.trim(reply)).isin("yes", "true"), F.lit(False))
