"""Destination checks against address and port rules.

A range rule allows addresses strictly inside it, so a range of one address
allows nothing. Rules are reduced to one row per (organisation, family, prefix,
network) holding disjoint port intervals; flows are reduced to distinct
(organisation, destination) before they meet the rules in an equality join on
the masked key. Only prefixes that an organisation uses are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.net import address, parse_cidr, prefix_key, unfolded

NETWORK = ["organization_id", "family", "prefix", "network"]
ANY_PORT = (0, 65536)


def usable_rules(rules: DataFrame, as_of: Column | None, direction: str) -> DataFrame:
    live = rules.filter("is_active").filter(F.col("direction").isin(direction, "both"))
    if "expires_at" in rules.columns:
        live = live.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return live


def rule_networks(rules: DataFrame) -> DataFrame:
    """Rule rows as (network, port_lo, port_hi); both targets of a rule count."""
    lo = F.coalesce("port_lo", F.lit(ANY_PORT[0])).cast("int").alias("port_lo")
    hi = F.coalesce("port_hi", F.lit(ANY_PORT[1])).cast("int").alias("port_hi")
    ranges = (unfolded(rules, parse_cidr("ip_range"))
              .filter(F.col("prefix") < F.when(F.col("family") == 4, 32).otherwise(128))
              .select(*NETWORK, lo, hi))
    width = F.when(F.col("family") == 4, 32).otherwise(128)
    single = (unfolded(rules, address("ip_address")).filter(F.col("key").isNotNull())
              .select("organization_id", "family", width.alias("prefix"), F.col("key").alias("network"), lo, hi))
    return ranges.unionByName(single).filter(F.col("port_lo") < F.col("port_hi"))


def merged_ports(networks: DataFrame) -> DataFrame:
    """Overlapping port intervals of a network joined into disjoint ones.

    After the first aggregate a network has at most one row per starting port,
    so the window below never sorts more than 65,536 rows.
    """
    widest = networks.groupBy(*NETWORK, "port_lo").agg(F.max("port_hi").alias("port_hi"))
    w = Window.partitionBy(*NETWORK).orderBy("port_lo")
    reach = F.max("port_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = widest.withColumn("fresh", F.when(reach >= F.col("port_lo"), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*NETWORK, "run").agg(F.min("port_lo").alias("lo"), F.max("port_hi").alias("hi"))
    return spans.groupBy(*NETWORK).agg(F.collect_list(F.struct("lo", "hi")).alias("ports"))


def destination_ports(destinations: DataFrame, rules: DataFrame) -> DataFrame:
    """The ports allowed for each destination some rule covers: (organization_id, destination_ip, ports).

    ``destinations`` must be distinct; ``rules`` comes from ``usable_rules``.
    """
    networks = merged_ports(rule_networks(rules))
    # at most 33 + 129 prefixes per organisation
    prefixes = networks.groupBy("organization_id", "family").agg(F.collect_set("prefix").alias("prefixes"))
    keyed = unfolded(destinations, address("destination_ip")).filter(F.col("key").isNotNull())
    tried = (keyed.join(prefixes, ["organization_id", "family"])
             .withColumn("prefix", F.explode("prefixes"))
             .withColumn("network", prefix_key("key", "family", "prefix")))
    # a destination lies in one network per prefix, so its list is as bounded as theirs
    return (tried.join(networks, NETWORK).groupBy("organization_id", "destination_ip")
            .agg(F.flatten(F.collect_list("ports")).alias("ports")))


def port_allowed(port: Column, ports: Column) -> Column:
    """Whether a destination's intervals cover the port; without a port any rule will do."""
    inside = F.exists(ports, lambda p: (port >= p["lo"]) & (port < p["hi"]))
    return F.coalesce(ports.isNotNull() & (port.isNull() | inside), F.lit(False))


def check_flows(flows: DataFrame, rules: DataFrame, as_of: Column | None = None,
                direction: str = "outbound") -> DataFrame:
    """``flows`` plus ``allowed``."""
    keys = ["organization_id", "destination_ip"]
    ports = destination_ports(flows.select(*keys).distinct(), usable_rules(rules, as_of, direction))
    return (flows.join(ports, keys, "left")
            .withColumn("allowed", port_allowed(F.col("dst_port"), F.col("ports"))).drop("ports"))
