"""Facility, demographic and climate-hazard analytics as Spark DataFrame transformations."""

from exposia.plans.files import Inputs, Published, build, publish, published
from exposia.plans.tables import exposure, facilities, heat_air_hazard, state_facilities

__version__ = "0.1.0"
__all__ = [
    "Inputs", "Published", "build", "exposure", "facilities", "heat_air_hazard", "publish", "published", "state_facilities",
]
