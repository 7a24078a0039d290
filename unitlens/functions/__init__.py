from unitlens.functions.metrics import as_money, mean, ratio, rounded
from unitlens.functions.times import load_time

__all__ = ["as_money", "load_time", "mean", "ratio", "rounded"]
