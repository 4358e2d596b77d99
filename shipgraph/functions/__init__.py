from .exprs import clip, entropy_terms, flag, hist_bin, normalise_output, rate, safe_div
from .quantile import global_quantiles, group_quantiles

__all__ = ["safe_div", "clip", "flag", "rate", "hist_bin", "normalise_output", "entropy_terms",
           "group_quantiles", "global_quantiles"]
