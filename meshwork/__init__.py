"""Spark-first statistical network analytics.

Names are imported when they are first used: Python workers that run one kernel load that kernel alone.
"""

from importlib import import_module

_PLACES = {
    "functions.bootstrap": ("BootstrapResult", "bootnet", "cs_coefficient", "difference_test"),
    "functions.centrality": (
        "betweenness",
        "centrality",
        "closeness",
        "expected_influence",
        "in_expected_influence",
        "in_strength",
        "out_expected_influence",
        "out_strength",
        "strength",
    ),
    "functions.community": ("communities", "greedy_modularity", "louvain", "walktrap"),
    "functions.estimation": ("NetworkEstimator", "available_methods", "estimate_network", "get_estimator", "register"),
    "functions.group": ("GroupBootstrapResult", "bootnet_group", "estimate_group_network"),
    "functions.multilevel": ("estimate_multilevel_network",),
    "functions.timeseries": ("estimate_var_network",),
    "network": ("EstimationInfo", "GroupNetwork", "MultilevelNetwork", "Network", "TSNetwork"),
    "plotting": (
        "get_theme",
        "plot_centrality",
        "plot_centrality_stability",
        "plot_community",
        "plot_difference",
        "plot_edge_accuracy",
        "plot_group_centrality_comparison",
        "plot_group_edge_accuracy",
        "plot_group_networks",
        "plot_multilevel_networks",
        "plot_network",
        "plot_ts_networks",
        "set_theme",
    ),
    "sources.datasets": ("make_bfi25", "make_depression9", "make_multigroup", "make_multilevel_data", "make_var_data"),
}
_FROM = {name: module for module, names in _PLACES.items() for name in names}

__all__ = sorted(_FROM)


def __getattr__(name: str):
    if name not in _FROM:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_FROM[name]}"), name)
