"""Addresses of both families and the networks that hold them.

An address is its 16 bytes as four numbers of 32 bits; one of four bytes is that of its mapped form (::ffff:a.b.c.d), so that both
notations of it are one. The longest network that holds an address is found by equality: for each length of prefix that
the networks have, the address cut to that length is looked up. So any number of networks is joined by hashing, and no range
is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import let

V4 = r"(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}"
WORDS = ["w0", "w1", "w2", "w3"]
#: Bytes of networks that are broadcast at most.
BROADCAST = 16 << 20


def hexadecimal(address: Column) -> Column:
    """32 hexadecimal digits of an address; null for what is none."""
    none = F.array().cast("array<string>")
    two = lambda a, b: F.lpad(F.lower(F.hex(a * 256 + b)), 4, "0")
    groups = lambda side: F.when(side == "", none).otherwise(F.split(side, ":"))

    def spread(plain: Column) -> Column:
        """The address with its last four bytes, if they are written so, as two groups; null if one of them is above 255."""
        tail = lambda b: F.when(F.forall(b, lambda x: x <= 255), F.concat(two(b[0], b[1]), F.lit(":"), two(b[2], b[3])))
        last = let(F.transform(F.split(F.regexp_extract(plain, rf"({V4})$", 1), r"\."), lambda x: x.cast("long")), tail)
        return F.when(plain.rlike(rf"^{V4}$"), F.concat(F.lit("::ffff:"), last)).when(plain.rlike(rf":{V4}$"), F.concat(F.regexp_replace(plain, rf"{V4}$", ""), last)).otherwise(plain)

    def filled(sides: Column) -> Column:
        """All groups; those that :: stands for are one at least. Null for more than one ::."""
        zeros = lambda s: F.concat(s["l"], F.array_repeat(F.lit("0"), 8 - F.size(s["l"]) - F.size(s["r"])), s["r"])
        both = F.struct(groups(sides[0]).alias("l"), groups(F.try_element_at(sides, F.lit(2))).alias("r"))
        return F.when(F.size(sides) == 1, groups(sides[0])).when(F.size(sides) == 2, let(both, lambda s: F.when(F.size(s["l"]) + F.size(s["r"]) < 8, zeros(s))))

    def joined(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return let(let(let(F.lower(F.trim(address)), spread), lambda whole: filled(F.split(whole, "::"))), joined)


def numbers(digits: Column) -> list[Column]:
    """w0 to w3 of an address of 32 hexadecimal digits; nulls for null."""
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(WORDS)]


def masked(bits: Column) -> list[Column]:
    """w0 to w3 cut to a prefix."""
    out = []
    for i, w in enumerate(WORDS):
        rest = F.least(F.lit(32), F.greatest(F.lit(0), 32 * (i + 1) - bits)).cast("int")
        out.append(F.call_function("shiftleft", F.call_function("shiftright", F.col(w), rest), rest).alias(w))
    return out


def parsed(networks: DataFrame) -> DataFrame:
    """Networks (network, and other columns) with bits and w0 to w3; those that can't be read are left out."""
    base, size = F.split_part("network", F.lit("/"), F.lit(1)), F.split_part("network", F.lit("/"), F.lit(2))
    own = F.when(F.contains(base, F.lit(":")), F.lit(0)).otherwise(F.lit(96))
    bits = F.when(size == "", F.lit(128)).otherwise(size.try_cast("int") + own)
    told = networks.withColumns({"bits": bits, "__digits": hexadecimal(base)})
    told = told.select(*networks.columns, "bits", *numbers(F.col("__digits"))).where("w0 IS NOT NULL AND bits BETWEEN 0 AND 128 AND (bits >= 96 OR network LIKE '%:%')")
    return told.select(*[c for c in told.columns if c not in WORDS], *masked(F.col("bits")))


def longest(addresses: DataFrame, networks: DataFrame, address: str = "address") -> DataFrame:
    """address and all columns of the longest network that holds it, for each different address that is in any; of equal networks one."""
    nets = parsed(networks).dropDuplicates(["bits", *WORDS])
    told = nets.agg(F.sort_array(F.collect_set("bits")), F.sum(F.octet_length("network") + 64)).first()  # at most 129 lengths
    if not told[0]:
        return addresses.select(address).limit(0).join(nets, F.lit(False))
    nets = F.broadcast(nets) if told[1] <= BROADCAST else nets
    asked = addresses.select(F.col(address)).distinct().withColumn("__digits", hexadecimal(F.col(address))).where("__digits IS NOT NULL").select(address, *numbers(F.col("__digits")))
    asked = asked.withColumn("bits", F.explode(F.array(*map(F.lit, told[0])))).select(address, "bits", *masked(F.col("bits")))
    met = asked.join(nets, ["bits", *WORDS])
    others = [c for c in nets.columns if c not in ("bits", *WORDS)]
    best = met.groupBy(address).agg(F.max_by(F.struct("bits", *others), "bits").alias("n"))
    return best.select(address, "n.*")


def clients(requests: DataFrame, networks: DataFrame, peer: str = "peer", forwarded: str = "forwarded") -> DataFrame:
    """Every request with ``client``: the first forwarded address if the peer is in one of the networks and it is an address, else the peer."""
    trusted = longest(requests, networks, peer).select(F.col(peer).alias("__peer"), F.lit(True).alias("__trusted"))
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    rows = requests.join(trusted, F.col(peer) == F.col("__peer"), "left")
    return rows.withColumn("client", F.when(F.col("__trusted") & hexadecimal(first).isNotNull(), first).otherwise(F.col(peer))).drop("__peer", "__trusted")
