"""barloom: event studies over keyed, ordered bar tables, as Spark DataFrames."""

from barloom.params import GridSpec, Market

__all__ = ["GridSpec", "Market"]
