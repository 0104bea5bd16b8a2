"""Column functions on addresses, names, flags and scores; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Service names that stand for ports.
SERVICE_PORTS = {"http": 80, "https": 443, "domain": 53, "dns": 53, "ssh": 22, "ntp": 123}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_flow_port(port: Column) -> Column:
    """Blank 0; ``0x`` and hex digits; decimal digits; a service name; else 0."""
    text = F.lower(F.trim(port))
    hexed = F.when(text.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10).cast("long"))
    plain = F.when(text.rlike("^[0-9]{1,9}$"), text.cast("long"))
    return F.coalesce(hexed, plain, F.try_element_at(_map(SERVICE_PORTS), text).cast("long"), F.lit(0).cast("long"))


def parse_flow_state(state: Column) -> Column:
    """Struct of the six flags that a flow's state string names."""
    text = F.upper(F.coalesce(state, F.lit("")))
    has = text.contains
    ack = has("A") | has("CON") | has("EST")
    return F.struct(has("S").alias("syn"), ack.alias("ack"), has("F").alias("fin"), has("R").alias("rst"), has("P").alias("psh"), has("U").alias("urg"))


def parse_flow_time(text: Column) -> Column:
    """Microseconds since 1970 in UTC of three formats; 0 if none fits."""
    formats = ("yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")
    stamps = [F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{f} xxx")) for f in formats]
    return F.coalesce(F.unix_micros(F.coalesce(*stamps)), F.lit(0).cast("long"))


def ip_to_long(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    parts = [F.try_element_at(F.split(ip, "\\."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    valid = ip.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")
    for p in parts:
        valid = valid & (p <= 255)
    return F.when(valid, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a block as numbers; an address alone is a block of one."""
    base = ip_to_long(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits = F.coalesce(F.nullif(F.split_part(cidr, F.lit("/"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    low = F.floor(base / size).cast("long") * size
    return F.when(bits.between(0, 32), low), F.when(bits.between(0, 32), low + size - 1)


def subnet_group(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 one, else the value."""
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    groups = F.slice(F.split(ip, ":"), 1, 3)
    v6 = F.concat(F.array_join(F.transform(groups, lambda g: F.when(g == "", "0").otherwise(g)), ":"), F.lit("::/48"))
    return F.when(ip_to_long(ip).isNotNull(), v4).when(ip.contains(":"), v6).otherwise(ip)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: what stands inside a lambda of an array function runs for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for empty and null texts.

    One pass over the distinct characters: each is counted by what its removal takes away."""
    chars = F.array_distinct(F.split(text, ""))
    n = F.length(text).cast("double")
    bits = F.aggregate(chars, F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(text, c, F.lit("")))) * F.log2((n - F.length(F.replace(text, c, F.lit("")))))))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - bits / n)).otherwise(0.0)


def byte_entropy(data: Column) -> Column:
    """Bits a byte, 0 to 8, of a binary; 0 for empty and null ones."""
    pairs = F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda x: x != "")

    def bits_a_byte(pairs: Column) -> Column:
        n = F.size(pairs).cast("double")
        counts = F.transform(F.array_distinct(pairs), lambda b: F.size(F.filter(pairs, lambda x: x == b)).cast("double"))
        bits = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c))
        return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - bits / n)).otherwise(0.0)

    return F.when(data.isNull(), 0.0).otherwise(let(pairs, bits_a_byte))


def leftmost_label(domain: Column) -> Column:
    return F.lower(F.split_part(domain, F.lit("."), F.lit(1)))


def lexical_features(domain: Column) -> dict[str, Column]:
    """Leftmost label in lower case, its length, entropy, share of digits, and share of vowels among its letters."""
    label = leftmost_label(domain)
    n = F.length(label).cast("double")
    letters = F.length(F.regexp_replace(label, "[^a-z]", "")).cast("double")
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return {
        "label": label,
        "label_length": F.length(label).cast("long"),
        "label_entropy": shannon_entropy(label),
        "digit_ratio": share(F.length(F.regexp_replace(label, "[^0-9]", "")), n),
        "vowel_ratio": share(F.length(F.regexp_replace(label, "[^aeiou]", "")), letters),
    }


def pst_pattern_matches(sizes: Column) -> Column:
    """Neighbouring packets of which one has 128 to 512 and the other 1024 to 4096 bytes, signs aside."""
    small = lambda x: F.abs(x).between(128, 512)
    large = lambda x: F.abs(x).between(1024, 4096)
    n = F.size(sizes)
    pairs = F.zip_with(F.slice(sizes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(sizes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (small(a) & large(b)) | (large(a) & small(b)))
    return F.coalesce(F.size(F.filter(pairs, lambda x: x)), F.lit(0)).cast("long")


def anomaly_to_prob(score: Column) -> Column:
    """An anomaly score, low for odd rows, as a probability."""
    return 1 / (1 + F.exp(F.least(F.greatest(10 * score, F.lit(-700.0)), F.lit(700.0))))


def fuse_score(rule: Column, ml: Column | None = None) -> Column:
    """The larger of a rule's score and a model's probability, in 0..1; the rule's where there is no model."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return clip(rule) if ml is None else F.greatest(clip(rule), F.coalesce(clip(ml), F.lit(0.0)))


def autocorr_peak(gaps: Column, max_lag: int = 9) -> Column:
    """Largest autocorrelation of an array over lags 1 to ``max_lag``, below its length; under four values 0, and 1 without
    variance."""
    n = F.size(gaps)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    lags = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(max_lag), n - 1)))

    def peak(centered: Column, power: Column) -> Column:
        at = lambda lag: total(F.zip_with(F.slice(centered, F.lit(1), n - lag), F.slice(centered, lag + 1, n - lag), lambda a, b: a * b)) / power
        return F.when(power / n <= 1e-6, 1.0).otherwise(F.array_max(F.transform(lags, at)))

    around = lambda mean: F.transform(gaps, lambda x: x - mean)
    found = let(let(total(gaps) / n, around), lambda c: let(total(F.transform(c, lambda x: x * x)), lambda power: peak(c, power)))
    return F.when(n < 4, 0.0).otherwise(found)
