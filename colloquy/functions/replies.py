"""What services answer, taken apart as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import strip, unfenced

BOX = "struct<term:string,definition:string,page:int,x:double,y:double,width:double,height:double>"


def entries(reply: Column, fields: str) -> Column:
    """The objects in the list ``entries`` of a fenced reply, as structs of ``fields``; none for anything else."""
    listed = F.from_json(F.get_json_object(unfenced(reply), "$.entries"), "array<string>")
    objects = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda o: F.coalesce(F.schema_of_variant(F.try_parse_json(o)).startswith("OBJECT"), F.lit(False)))
    return F.transform(objects, lambda o: F.from_json(o, fields))


def annotations_of(raw: Column) -> Column:
    """Annotation boxes of their JSON, numbers also where they are quoted."""
    plain = "array<struct<" + ",".join(f"{c.split(':')[0]}:string" for c in BOX[7:-1].split(",")) + ">>"
    return F.from_json(raw, plain).cast(f"array<{BOX}>")


def annotations_json(boxes: Column) -> Column:
    return F.to_json(boxes.cast(f"array<{BOX}>"))


def embedding_of(reply: Column) -> Column:
    """The vector of an embedding reply; null where there is none."""
    values = F.from_json(F.get_json_object(reply, "$.embedding.values"), "array<double>")
    return F.when(F.size(values) > 0, values)


def reply_text(reply: Column) -> Column:
    """The non-blank text parts of a model reply's first candidate, joined by line feeds; null where there are none."""
    parts = F.from_json(F.get_json_object(reply, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: F.coalesce(strip(t) != "", F.lit(False)))
    return F.nullif(strip(F.array_join(texts, "\n")), F.lit(""))


def descriptions(found: Column) -> Column:
    """Descriptions of a document's images, failures left out, a blank line between; null only if all failed."""
    return F.when(F.size(F.array_compact(found)) > 0, F.array_join(F.array_compact(found), "\n\n"))
