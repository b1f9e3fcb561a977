"""Fixed values of the drainage domain: tables and thresholds that results depend on, stated as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Manning's n by material code.
MATERIAL_N = {
    "PVC": 0.010, "VT": 0.013, "VITC": 0.013, "VC": 0.013, "CONC": 0.013, "CON": 0.013, "RC": 0.013, "CO": 0.013, "CP": 0.013,
    "AC": 0.011, "ASB": 0.011, "PE": 0.011, "HDPE": 0.011, "CMP": 0.024, "CSP": 0.024, "DI": 0.013, "CI": 0.013, "CAST": 0.013,
    "BR": 0.015, "BRK": 0.015, "STL": 0.012, "STEEL": 0.012,
}
DEFAULT_N = 0.013

# Section type by published shape word.
SHAPES = {
    "ROUND": "CIRCULAR", "CIRC": "CIRCULAR", "CIRCULAR": "CIRCULAR", "R": "CIRCULAR",
    "RECT": "RECT_CLOSED", "RECTANGULAR": "RECT_CLOSED", "BOX": "RECT_CLOSED", "SQUARE": "RECT_CLOSED", "RECT_CLOSED": "RECT_CLOSED", "CLOSED_RECT": "RECT_CLOSED",
    "EGG": "EGG", "E": "EGG", "ARCH": "ARCH", "CMPA": "ARCH", "ELLIPSE": "HORIZ_ELLIPSE", "ELLIPTICAL": "HORIZ_ELLIPSE", "ELH": "HORIZ_ELLIPSE",
    "HORSESHOE": "HORSESHOE", "HS": "HORSESHOE", "TRAPEZOIDAL": "TRAPEZOIDAL",
}

# Network assembly.
EARTH_RADIUS_M = 6_371_000.0
MIN_SLOPE = 0.001
DEFAULT_DEPTH_M = 2.0
FALLBACK_NODE_DEPTH_M = 2.5
DEFAULT_DIAMETER_M = 0.30
OUTFALL_LINK_M = 10.0
MAX_OFFSET_M = 10.0
MAX_NODE_DEPTH_M = 15.0

# Commercial pipe diameters (m) and the sizing method's assumptions.
DIAMETERS_M = (0.30, 0.375, 0.45, 0.525, 0.60, 0.675, 0.75, 0.90, 1.05, 1.20, 1.35, 1.50, 1.80, 2.10, 2.40, 3.00)
INLET_TIME_MIN, TRAVEL_VELOCITY_MS, C_IMPERVIOUS, C_PERVIOUS = 10.0, 1.0, 0.9, 0.2

# Gates of climate records.
HOURLY_COVERAGE, HOURLY_GAP_H, DAILY_COVERAGE, DAILY_GAP_D, MISMATCH_PCT, TRACE_MM = 0.90, 24, 0.90, 3, 15.0, 1.0
DATUM_PREFERENCE = ("CGVD28", "CGVD2013")
FRAMES = ("CRS84", "EPSG::4326", "EPSG:4326")
TIDE_COVERAGE = 0.9
STATION_TRIES = 40
COMPLETE = 0.999

# Dry-weather loading.
LITRES_PER_PERSON_DAY, PERSONS_PER_DWELLING, PERSONS_PER_HA = 280.0, 2.4, 45.0
DIURNAL = (0.44, 0.34, 0.29, 0.28, 0.32, 0.55, 1.02, 1.45, 1.61, 1.54, 1.42, 1.32, 1.25, 1.20, 1.15, 1.13, 1.18, 1.30, 1.38, 1.32, 1.16, 0.97, 0.76, 0.58)
FLOW_UNITS = {"CMS": 1.0e-3, "LPS": 1.0, "MLD": 86.4e-3, "CFS": 0.0353147, "GPM": 15.8503, "MGD": 0.0228245}

# Soil. Horton (f0, fc, decay) by soil group; Green-Ampt (psi, ksat, deficit) by texture, coded 1 to 12 in this order; texture that stands for a soil group.
HORTON = {"A": (127.0, 9.5, 4.14), "B": (101.6, 5.7, 4.14), "C": (76.2, 2.5, 4.14), "D": (50.8, 0.6, 4.14)}
GREEN_AMPT = {
    "sand": (49.5, 117.8, 0.417), "loamy sand": (61.3, 29.9, 0.401), "sandy loam": (110.1, 10.9, 0.412), "loam": (88.9, 6.6, 0.434),
    "silt loam": (166.8, 3.4, 0.486), "silt": (166.8, 3.4, 0.486), "sandy clay loam": (218.5, 1.5, 0.330), "clay loam": (208.8, 1.0, 0.390),
    "silty clay loam": (273.0, 1.0, 0.432), "sandy clay": (239.0, 0.6, 0.321), "silty clay": (292.2, 0.5, 0.423), "clay": (316.3, 0.3, 0.385),
}
GROUP_TEXTURE = {"A": "loamy sand", "B": "loam", "C": "clay loam", "D": "clay"}
GROUP_CODES = {1: "A", 2: "B", 3: "C", 4: "D", 11: "A", 12: "B", 13: "C", 14: "D"}

# Land-cover classes 1 to 19. Category of each class, impervious share, Manning's n, and curve numbers by category and soil group.
COVER_CATEGORY = {
    1: "forest", 2: "forest", 3: "forest", 4: "forest", 5: "forest", 6: "forest", 7: "shrub", 8: "shrub", 9: "grass", 10: "grass",
    11: "shrub", 12: "grass", 13: "barren", 14: "wetland", 15: "crop", 16: "barren", 17: "built", 18: "water", 19: "barren",
}
COVER_IMPERVIOUS = {9: 0.02, 10: 0.02, 13: 0.05, 15: 0.02, 16: 0.05, 17: 0.70}  # others 0
COVER_N = {
    1: 0.12, 2: 0.12, 3: 0.12, 4: 0.12, 5: 0.12, 6: 0.12, 7: 0.08, 8: 0.08, 9: 0.035, 10: 0.035,
    11: 0.08, 12: 0.035, 13: 0.03, 14: 0.08, 15: 0.045, 16: 0.03, 17: 0.12, 18: 0.035, 19: 0.03,
}
CURVE_NUMBERS = {
    "forest": {"A": 30.0, "B": 55.0, "C": 70.0, "D": 77.0}, "shrub": {"A": 35.0, "B": 56.0, "C": 70.0, "D": 77.0},
    "grass": {"A": 39.0, "B": 61.0, "C": 74.0, "D": 80.0}, "crop": {"A": 67.0, "B": 78.0, "C": 85.0, "D": 89.0},
    "wetland": {"A": 85.0, "B": 85.0, "C": 85.0, "D": 85.0}, "barren": {"A": 77.0, "B": 86.0, "C": 91.0, "D": 94.0},
    "built": {"A": 49.0, "B": 69.0, "C": 79.0, "D": 84.0}, "water": {"A": 98.0, "B": 98.0, "C": 98.0, "D": 98.0},
}

# The published texture triangle (percent of clay, sand and silt). A row is a region of a class: bounds that quantities keep,
# from the first number on and below the second one; sand's are beyond the first and up to the second.
TEXTURES = (
    ("sand", {"silt + 1.5 * clay": (None, 15)}),
    ("loamy sand", {"silt + 1.5 * clay": (15, None), "silt + 2 * clay": (None, 30)}),
    ("sandy loam", {"silt + 2 * clay": (30, None), "clay": (7, 20), "sand": (52, None)}),
    ("sandy loam", {"silt + 2 * clay": (30, None), "clay": (None, 7), "silt": (None, 50)}),
    ("loam", {"clay": (7, 27), "silt": (28, 50), "sand": (None, 52)}),
    ("silt loam", {"clay": (12, 27), "silt": (50, None)}),
    ("silt loam", {"clay": (None, 12), "silt": (50, 80)}),
    ("silt", {"clay": (None, 12), "silt": (80, None)}),
    ("sandy clay loam", {"clay": (20, 35), "silt": (None, 28), "sand": (45, None)}),
    ("clay loam", {"clay": (27, 40), "sand": (20, 45)}),
    ("silty clay loam", {"clay": (27, 40), "sand": (None, 20)}),
    ("sandy clay", {"clay": (35, None), "sand": (45, None)}),
    ("silty clay", {"clay": (40, None), "silt": (40, None)}),
    ("clay", {"clay": (40, None), "sand": (None, 45), "silt": (None, 40)}),
)
TEXTURE_UNKNOWN = "loam"
TEXTURE_SLACK = 0.5  # percent that clay and sand may exceed 100 together

# Clay and sand percents that set soil groups C and D, and A.
GROUP_C_CLAY, GROUP_D_CLAY, GROUP_A_SAND, GROUP_A_CLAY = 27, 40, 50, 10

# Symbol types that carry rims and those that seed inlets, labels and confidence of delineation methods, and their decisions.
RIM_TYPES = ("CB/MH", "MANHOLE", "MANHOLE, DUMMY", "SETTLING CHAMBER")
SEED_TYPES = ("CATCHBASIN", "CB/MH", "LAWN BASIN")
METHODS = {
    "street": ("junction_street_segment", "medium"), "inlets_kerbed": ("catchbasin_dem", "high"), "inlets": ("catchbasin_dem", "medium"), "parcel": ("catchbasin_parcel", "medium"),
    "voronoi": ("fallback_voronoi_catchbasin", "low"), "terrain": ("junction_dem", "medium"), "nearest": ("fallback_voronoi_junction", "low"),
}
DECISIONS = ("corridor_frontage", "corridor_voronoi", "no_dem", "no_dem_overlap", "below_slope_gate", "dem_degenerate", "posterior_fallback", "noise_cell_fallback", "dem")
NOISE_SHARE = 0.5  # over this share of cells under the least size, a delineation is noise
NOISE_HA = 0.05
CELL_OUTSIDE_ERROR = 0.5
AREA_OUTSIDE_WARNING = 0.02
INFILTRATION_DRY_DAYS, CURVE_NUMBER_KSAT, DEFAULT_CN = 7.0, 0.5, 61.0

# Validation and capability thresholds.
INVERT_RISE_TOL_M = 0.01
OUTLET_WARN_M, OUTLET_HIGH_M = 20.0, 50.0
SHAPE_AREA_FACTOR, SHAPE_THINNESS = 20.0, 8.0
SLOPE_GATE_PCT, SLOPE_GATE_FINE_PCT, FINE_POSTING_M = 4.0, 1.0, 10.0
OVERLAP_WARN, OVERLAP_ERROR, CONSERVATION_TOL, UNCOVERED_WARN, UNCOVERED_ERROR = 0.005, 0.05, 0.05, 0.02, 0.10
RATIO_LEVEL_2, RATIO_CANDIDATE, AGREEMENT, AGREEMENT_SAMPLE = 0.05, 0.5, 0.95, 30

# Layer roles by the first pattern that matches, in this order, and names that are no drainage asset.
ROLE_PATTERNS = (
    (r"sub[\s_-]?catchment|sub[\s_-]?watershed|sub[\s_-]?basin", "subcatchment"),
    (r"catchment|drainage[\s_-]?area|sewershed|watershed", "catchment"),
    (r"catch[\s_-]?basin", "catch_basin"),
    (r"\binlet", "inlet"),
    (r"lateral|service[\s_-]?connection|\bservices?\b|\bstub\b", "lateral"),
    (r"combined[\s_-]?(sewer[\s_-]?)?overflow|\bcso\b|\bscso\b|overflow", "cso"),
    (r"interceptor|trunk", "interceptor"),
    (r"outfall|discharge[\s_-]?point|\boutlet(s)?\b", "outfall"),
    (r"manhole|maintenance[\s_-]?hole|\bmh\b|access[\s_-]?chamber", "manhole"),
    (r"gravity[\s_-]?main|\bmain(s)?\b|\bpipe(s|line)?\b|\bsewer(s)?\b|conduit|culvert", "gravity_main"),
    (r"parcel|\bproperty|\bfolio|cadastr", "parcel"),
    (r"building|structure[\s_-]?footprint|\broof", "building"),
    (r"\bcurb|\bkerb|gutter|sidewalk", "curb"),
)
NOT_DRAINAGE = r"\bwater[\s_-]?(main|lateral|service|valve|meter|hydrant|node|line|pipe|distribution)|potable|methane|\bgas\b|hydro|electric|fib(re|er)|telecom|irrigation|\bwatermain"
PRESSURISED = r"force[\s_-]?main|pressuri[sz]ed|siphon|\bfm\b"
DERIVATIVE = r"flow[\s_-]?arrow|arrow|annotation|\blabel|dimension|index[\s_-]?grid|clean[\s_-]?out|abandoned|proposed|decommission|shadow|outline"
DRAFT = r"\bprelim(inary)?\b|\bdraft\b|\btest\b"
SANITARY, COMBINED, STORM = r"sanitary|wastewater|waste[\s_-]?water|\bsan\b|foul", r"combined", r"storm|surface[\s_-]?water|land[\s_-]?drain|\bdrainage\b"
KEYWORDS = (
    "storm", "sewer", "sanitary", "wastewater", "drain", "combined", "catch", "basin", "inlet", "lateral", "manhole", "outfall", "discharge",
    "cso", "overflow", "interceptor", "parcel", "propert", "building", "structure", "curb", "planimetr", "land", "utilit", "subcatch",
    "watershed", "subwatershed", "catchment", "wwtp", "treatment", "pump",
)
POLYGON, POLYLINE, POINT, MULTIPOINT = "esriGeometryPolygon", "esriGeometryPolyline", "esriGeometryPoint", "esriGeometryMultipoint"
EXPECTED_GEOMETRY = {
    "catchment": (POLYGON,), "subcatchment": (POLYGON,), "parcel": (POLYGON,), "building": (POLYGON,),
    "catch_basin": (POINT, MULTIPOINT), "inlet": (POINT, MULTIPOINT), "manhole": (POINT, MULTIPOINT),
    "outfall": (POINT, MULTIPOINT, POLYGON), "cso": (POINT, MULTIPOINT, POLYGON),
    "lateral": (POLYLINE,), "gravity_main": (POLYLINE,), "interceptor": (POLYLINE,), "curb": (POLYLINE,),
}
ANCHORS = {"storm": ("catch_basin", "inlet", "manhole"), "combined": ("catch_basin", "inlet", "gravity_main", "manhole"), "sanitary": ("gravity_main", "manhole")}


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """A column's entry in a fixed table, as an expression: no join, no shuffle."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))

# Ingest rules by city. Sentinel policy of inverts, band of plausible inverts, band of plausible rims (None: no band), decimals to which ends snap.
CITY_RULES = (
    ("abbotsford", "below:0", None, None, 0.5, 700.0, 5), ("barrie", "zero", None, None, 150.0, 400.0, 5), ("burnaby", "zero", None, None, None, None, 5),
    ("calgary", "zero", None, None, 900.0, 1400.0, 5), ("chilliwack", "zero", 0.5, 400.0, 0.5, 400.0, 5), ("coquitlam", "zero", None, None, 0.5, 450.0, 5),
    ("delta", "below:-90", None, None, 0.0, None, 5), ("esquimalt", "zero", None, None, 0.5, 120.0, 5), ("greater_sudbury", "zero", 200.0, 420.0, 200.0, 420.0, 5),
    ("kamloops", "none", 300.0, 900.0, 300.0, 900.0, 5), ("kelowna", "none", None, None, 300.0, 700.0, 5), ("kingston", "none", 60.0, 200.0, None, None, 5),
    ("kitchener", "zero", None, None, None, None, 6), ("langley", "zero", None, None, 0.5, 200.0, 5), ("london", "none", None, None, 0.0, None, 6),
    ("moncton", "zero", None, None, 0.5, 150.0, 5), ("nanaimo", "zero", None, None, 0.5, 350.0, 5), ("new_westminster", "zero", None, None, 0.5, 200.0, 5),
    ("north_vancouver_district", "below:-90", None, None, None, None, 5), ("ottawa", "below:0", None, None, None, None, 5), ("penticton", "zero", None, None, None, None, 5),
    ("peterborough", "zero", None, None, 150.0, 400.0, 5), ("port_coquitlam", "below:-90", None, None, 0.5, 250.0, 5), ("regina", "none", 500.0, 700.0, 500.0, 700.0, 5),
    ("reykjavik", "none", None, None, None, None, 5), ("sarnia", "zero", 150.0, 250.0, None, None, 5), ("saskatoon", "zero", None, None, 400.0, 650.0, 5),
    ("strathcona", "zero", None, None, 550.0, 850.0, 5), ("surrey", "none", None, None, 0.5, 200.0, 5), ("toronto", "zero", None, None, 60.0, 300.0, 5),
    ("vancouver", "zero", -20.0, 300.0, -10.0, 300.0, 6), ("victoria", "none", None, None, None, None, 6), ("whitby", "zero", None, None, None, None, 5),
    ("white_rock", "zero", None, None, 0.5, 200.0, 5), ("windsor", "zero", 150.0, 220.0, None, None, 5),
)
CITY_RULE_SCHEMA = "city string, policy string, invert_low double, invert_high double, rim_low double, rim_high double, snap_decimals int"
