"""Constants of the analysis. Distances are metres, angles degrees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    level_height: float = 3.0
    tessellation_min_area: float = 10.0
    domain_border: float = 1000.0
    nearest_street: float = 200.0
    building_radius: float = 300.0
    knn: int = 20
    enclosure_inset: float = 10.0
    forward_angle_cut: float = 45.0
    continuity_length: float = 1000.0
    continuity_angle: float = 25.0
    stretch_length: float = 500.0
    stretch_angle: float = 40.0
    right_ray: float = 300.0
    right_min: float = 6.0
    right_major_ray: float = 2000.0
    right_major_min: float = 50.0
    regular_steps: int = 5
    major_steps: int = 7
    entropy_bins: int = 35
    entropy_shift: float = 5.0
    cell: float = 100.0
    missing_cell: int = 99
    histogram_bins: int = 10
    sample_rows: int = 10_000


CONFIG = Config()

# Tag tables that results depend on.
SPEEDS = {
    "motorway": 110, "trunk": 90, "primary": 80, "secondary": 70, "tertiary": 60, "unclassified": 50, "residential": 30,
    "motorway_link": 80, "trunk_link": 70, "primary_link": 60, "secondary_link": 50, "tertiary_link": 40, "living_street": 20,
    "service": 20, "pedestrian": 10, "track": 20, "road": 50,
}
FALLBACK_SPEED = 50
TYPE_CATEGORIES = {
    "highway": ["motorway", "motorway_link", "trunk", "trunk_link"],
    "major": ["primary", "secondary", "tertiary"],
    "street": ["living_street", "residential", "pedestrian", "unclassified", "service"],
    "path": ["path", "footway", "steps"],
}
EDGE_CLASSES = {"highway": 4, "major": 3, "street": 2}
OTHER_EDGE_CLASS = 1
LANDUSE_CLASSES = {
    "residential": ["residential"],
    "industrial": ["industrial", "factory", "manufacture", "warehouse"],
    "retail": ["retail", "shop", "supermarket", "mall"],
    "commercial": ["commercial", "office", "bank", "government", "institutional"],
    "airport": ["airport"],
}
BUILDING_CLASS_CODES = {
    "apartments": 14, "big_commercial": 15, "complex": 16, "detached": 17, "filled_block": 18, "industrial": 19,
    "irregular_block": 20, "perimeter_block": 21, "terraced": 22,
}
BUILDING_SUBTYPES = {
    "agricultural": ["barn", "conservatory", "cowshed", "farm_auxiliary", "greenhouse", "slurry_tank", "stable", "sty", "livestock"],
    "civic": ["bakehouse", "bridge", "civic", "fire_station", "government", "gatehouse", "kindergarten", "museum", "public", "toilets", "train_station", "transportation"],
    "commercial": ["commercial", "kiosk", "office", "retail", "supermarket", "warehouse"],
    "education": ["school", "university", "college"],
    "entertainment": ["grandstand", "pavilion", "riding_hall", "sports_hall", "sports_centre", "stadium"],
    "industrial": ["industrial"],
    "medical": ["hospital"],
    "military": [],
    "outbuilding": ["allotment_house", "boathouse", "hangar", "hut", "shed"],
    "religious": ["religious", "cathedral", "chapel", "church", "kingdom_hall", "monastery", "mosque", "presbytery", "shrine", "synagogue", "temple"],
    "residential": [
        "apartments", "barracks", "bungalow", "cabin", "detached", "annexe", "dormitory", "farm", "ger", "hotel", "house", "houseboat",
        "residential", "semidetached_house", "static_caravan", "stilt_house", "terrace", "tree_house", "trullo",
    ],
    "service": [],
    "transportation": [],
}
OSM_RENAMES = {"building": "class", "height": "real_height", "building:levels": "real_levels", "roof:shape": "roof_shape", "name": "name"}
EXCLUDED_LABELS = ["outbuilding", "invalid", "semi_detached", "agriculture", "tower"]
