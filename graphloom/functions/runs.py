"""Run names: from hyper-parameters to a name and back, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How run names shorten parameters.
SHORT = {
    "hidden_dim": "h",
    "hidden_channels": "h",
    "num_layers": "l",
    "heads": "head",
    "dropout": "d",
    "dropout_rate": "d",
    "weight_decay": "wd",
    "learning_rate": "lr",
    "batch_size": "bs",
    "epochs": "ep",
    "K": "k",
    "top_k": "topk",
}
#: Model names in the order in which a path is searched for them; the first is also the fallback.
MODELS = ["GCN", "GAT", "GIN", "ChebNet", "SimpleSpringGNN", "MultiScaleSpringGNN", "AntiSmoothingSpringGNN", "ForceGNN", "FRUnrolled"]


def run_key(params: Column) -> Column:
    """The key of a map<string,string>: parameters by name, shortened; a value with a decimal point has three digits at most.
    An empty map or null is `default`."""
    short = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    digits = lambda v: F.regexp_replace(F.format_string("%.3f", v.try_cast("double")), r"\.?0+$", "")
    value = lambda v: F.when(v.rlike(r"^-?\d*\.\d+([eE]-?\d+)?$|^-?\d+\.?\d*[eE]-?\d+$|^-?\d+\.$"), digits(v)).otherwise(v)
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.coalesce(short[e["key"]], e["key"]), value(e["value"])))
    return F.when(F.size(params) > 0, F.array_join(parts, "_")).otherwise("default")


def parse_run_name(path: Column) -> Column:
    """A struct of the parameters that the file's name tells; null where it tells none of them."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    number = lambda pattern, kind: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast(kind)
    flag = lambda key: F.when(name.contains(f"{key}True"), True).when(name.contains(f"{key}False"), False)
    found = {
        "dropout": number(r"d([\d.]+)", "double"),
        "hidden_dim": number(r"h(\d+)", "int"),
        "num_layers": number(r"l(\d+)", "int"),
        "top_k": number(r"topk(\d+)", "int"),
        "use_input_mlp": flag("use_input_mlp"),
        "use_residual": flag("use_residual"),
    }
    return F.when(F.coalesce(*(F.when(c.isNotNull(), True) for c in found.values())), F.struct(*(c.alias(k) for k, c in found.items())))


def detect_model(path: Column) -> Column:
    """The first model whose name the path holds in any case; else the first of all."""
    low = F.lower(path)
    return F.coalesce(*(F.when(low.contains(m.lower()), m) for m in MODELS), F.lit(MODELS[0]))


def graph_name(kind: Column, number: Column) -> Column:
    """ER_0007"""
    return F.format_string("%s_%04d", kind, number)


def bundle_name(prefix: Column, num_graphs: Column, low: Column, high: Column, stamp: Column) -> Column:
    """prefix_10graphs_20-50nodes_stamp"""
    span = F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))
    return F.concat(prefix, F.lit("_"), num_graphs.cast("string"), F.lit("graphs_"), span, F.lit("nodes_"), stamp)
