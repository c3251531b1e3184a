
from . import canopy, debris, regeneration, report, sites, trees, water

__all__ = ["canopy", "debris", "regeneration", "report", "sites", "trees", "water"]
