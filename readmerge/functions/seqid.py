"""Read identifiers: parsing of five header formats, printing, equality and order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELDS = ("instrument", "run", "flowcell", "lane", "tile", "x", "y", "tag")
TYPE = "struct<instrument:string,run:string,flowcell:string,lane:int,tile:int,x:int,y:int,tag:string>"
FORMATS = {0: "unknown", 1: "SRA", 2: "EBI", 3: "1.4", 4: "1.7+", 5: "converted"}
MAX_TEXT, MAX_TAG = 100, 50

# Delimiters : # / and blank are interchangeable; an empty number is 0.
_D, _W, _I = "[:#/ ]", "([^:#/ ]{0,%d})" % MAX_TEXT, r"(\d{0,9})"
_TAG = "([^:#/ ]{0,%d})" % (MAX_TAG - 1)
_SRA = r"^([SE])RR(\d{1,9})[. ](\d{0,9})[. ].*$"
_OLD = f"^{_W}{_D}{_I}{_D}{_I}{_D}{_I}{_D}{_I}(?:#{_TAG})?/([123])$"
_CONVERTED = f"^{_W}{_D}{_W}{_D}{_W}{_D}{_I}{_D}{_I}{_D}{_I}{_D}{_I}(?:#{_TAG})?/([123])$"
_NEW = f"^{_W}{_D}{_W}{_D}{_W}{_D}{_I}{_D}{_I}{_D}{_I}{_D}{_I}{_D}([123]){_D}[YN]{_D}\\d*{_D}{_TAG}$"


def parse(header: Column, tag: str = "present") -> Column:
    """struct<id, mate, format> of a header without ``@``; mate 0 and a null id on error.

    ``tag``: ``present`` rejects an empty tag, ``absent`` any tag, ``optional`` takes both; SRA and EBI have none.
    """
    num = lambda c: F.when(c == "", 0).otherwise(c.cast("int"))
    colons = F.length(F.regexp_replace(F.split(header, "#").getItem(0), "[^:]", ""))
    empty, zero = F.lit(""), F.lit(0)
    none = F.struct(F.lit(None).cast(TYPE).alias("id"), F.lit(0).alias("mate"), F.lit("unknown").alias("format"))

    def ident(*values):
        return F.struct(*[v.alias(k) for k, v in zip(FIELDS, values, strict=True)])

    def matched(pattern: str, groups: int, out, form: str, tagged: bool = True):
        """One match gives all fields of a header; ``out`` makes the identifier and the mate from them."""
        fields = F.split(F.regexp_replace(header, pattern, "\x01".join(f"${i}" for i in range(1, groups + 1))), "\x01", -1)

        def row(p):
            i, mate = out(lambda k: p[k - 1])
            whole = F.struct(i.alias("id"), mate.cast("int").alias("mate"), F.lit(form).alias("format"))
            return F.when({"present": i["tag"] != "", "absent": i["tag"] == "", "optional": F.lit(True)}[tag], whole).otherwise(none) if tagged else whole

        return F.when(header.rlike(pattern), F.transform(F.array(fields), row)[0]).otherwise(none)

    sra = lambda form: matched(_SRA, 3, lambda g: (ident(F.concat(g(1), F.lit("RR"), g(2).cast("int").cast("string")), empty, empty, num(g(3)), zero, zero, zero, empty), F.lit(1)), form, False)
    old = matched(_OLD, 7, lambda g: (ident(g(1), empty, empty, *map(num, (g(2), g(3), g(4), g(5))), g(6)), g(7)), "1.4")
    converted = matched(_CONVERTED, 9, lambda g: (ident(g(1), g(2), g(3), *map(num, (g(4), g(5), g(6), g(7))), g(8)), g(9)), "converted")
    new = matched(_NEW, 9, lambda g: (ident(g(1), g(2), g(3), *map(num, (g(4), g(5), g(6), g(7))), g(9)), g(8)), "1.7+")
    archive = header.rlike("^[SE]RR") & (F.length(header) > 3)
    return (
        F.when(header.isNull(), none)
        .when(archive & header.rlike(_SRA), F.when(header.startswith("S"), sra("SRA")).otherwise(sra("EBI")))
        .when(archive, none)
        .when(F.contains(header, F.lit("/")) & (colons == 6), converted)
        .when(F.contains(header, F.lit("/")), old)
        .otherwise(new)
    )


def to_string(i: Column) -> Column:
    """``instrument:run:flowcell:lane:tile:x:y:tag``."""
    return F.concat_ws(":", *[i[f].cast("string") for f in FIELDS])


def has_direction(form: Column) -> Column:
    """Whether a format tells the mates apart."""
    return ~form.isin("SRA", "EBI")


def order_key(i: Column) -> Column:
    """A value by which identifiers sort: instrument, run, flowcell, lane, tile, x, y, tag; null identifiers have none."""
    return F.when(i.isNotNull(), F.struct(*[i[f].alias(f) for f in FIELDS]))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as one identifier sorts before, with or behind another; null if either is."""
    x, y = order_key(a), order_key(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def equal(a: Column, b: Column) -> Column:
    """All fields agree."""
    return order_key(a) == order_key(b)


def format_name(code: Column) -> Column:
    """The name of a format's number."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in FORMATS.items():
        out = out.when(code == k, v)
    return out.otherwise(FORMATS[0])
