"""cargoscope: shipment telemetry analytics as Spark DataFrame operators.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver. See README.md for the map
from operators to modules.
"""

__version__ = "0.1.0"
