"""Fixed values of the domain; results must agree on them."""

MIN_TRIP_S, MAX_TRIP_S = 60, 14_400
LAT_BOX, LNG_BOX = (39.5, 41.5), (-75.0, -73.0)
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring",
           6: "summer", 7: "summer", 8: "summer", 9: "fall", 10: "fall", 11: "fall"}
# Alternate ids of a station at the same spot; merged only where the base id is present.
SUFFIX_IDS = {"3184.07_OLD": "3184.07", "5308.04_": "5308.04", "6517.08_": "6517.08", "6569.09_": "6569.09"}
EARTH_M, EARTH_KM = 6_371_000.0, 6_371.0
NEAR_HOUSING_M, NEAR_SCHOOL_M, TRANSIT_GAP_M = 300, 300, 800
ZONE_CELL_KM = 6.0
ADJACENT_M = 500.0
PERSISTENCE_MINUTES = 70
AM_HOURS, PM_HOURS = (6, 7, 8, 9), (16, 17, 18, 19)
CHECK_AM_HOURS, CHECK_PM_HOURS = (7, 8, 9), (17, 18, 19)
DEFICIT, SURPLUS = -1.0, 1.0
TRUCK_CAPACITY, TRUCKS, MAX_STOPS = 20, 1, 45
FLEET_SIZES = tuple(range(1, 11))
LOW_VOLUME = 1.0
K_RANGE, SEED, RESTARTS = (2, 8), 0, 10
NAMING_MARGIN = 0.15
RANKABLE = 20
BAND_EDGES = (20, 40)
MIN_DAYS, MIN_CAPACITIES = 10, 8
Z95 = 1.96
CEILING_RHO = -0.3
EXTRAPOLATION_C = 5.0
VALIDATION_FRACTION = 0.15
MORNING_HOURS = tuple(range(5, 12))
MIN_PEAK_SHIFT = 2
PRESETS = (("rain", 15.6, 10.2), ("snow", -2.2, 7.6), ("ideal", 22.2, 0.0), ("hot", 31.0, 0.0))
HOLIDAY_DIP, SEASON_RATIO = 0.3, 1.5
MAX_SENTENCES, MAX_WORDS = 3, 90
