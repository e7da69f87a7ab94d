"""Lookup tables and texts whose values are part of the results.

Everything in this module is a fixed value: it has to read exactly like this for the
answers to be right. No logic lives here.
"""

# Airport code, latitude, longitude.
AIRPORTS = (
    ("ATL", 33.6407, -84.4277), ("ORD", 41.9742, -87.9073), ("DFW", 32.8998, -97.0403),
    ("DEN", 39.8561, -104.6737), ("JFK", 40.6413, -73.7781), ("LAX", 33.9416, -118.4085),
    ("SFO", 37.6213, -122.3790), ("SEA", 47.4502, -122.3088), ("MIA", 25.7959, -80.2870),
    ("BOS", 42.3656, -71.0096), ("CLT", 35.2140, -80.9431), ("PHX", 33.4342, -112.0116),
    ("IAH", 29.9902, -95.3368), ("MCO", 28.4312, -81.3081), ("EWR", 40.6895, -74.1745),
    ("MSP", 44.8848, -93.2223), ("DTW", 42.2162, -83.3554), ("PHL", 39.8729, -75.2437),
    ("LGA", 40.7769, -73.8740), ("BWI", 39.1774, -76.6684), ("SLC", 40.7899, -111.9791),
    ("SAN", 32.7338, -117.1933), ("IAD", 38.9531, -77.4565), ("DCA", 38.8512, -77.0402),
    ("MDW", 41.7868, -87.7522), ("TPA", 27.9755, -82.5332), ("PDX", 45.5898, -122.5951),
    ("HNL", 21.3187, -157.9225), ("BNA", 36.1263, -86.6774), ("AUS", 30.1975, -97.6664),
    ("DAL", 32.8471, -96.8518), ("STL", 38.7499, -90.3748), ("MSY", 29.9934, -90.2580),
    ("SMF", 38.6954, -121.5908), ("SJC", 37.3639, -121.9289), ("SNA", 33.6757, -117.8674),
    ("RDU", 35.8801, -78.7880), ("CLE", 41.4058, -81.8494), ("IND", 39.7173, -86.2944),
    ("PIT", 40.4915, -80.2329), ("SAT", 29.5337, -98.4698), ("CVG", 39.0537, -84.6621),
    ("CMH", 39.9980, -82.8919), ("RSW", 26.5362, -81.7552), ("PBI", 26.6832, -80.0956),
    ("JAX", 30.4941, -81.6879), ("ANC", 61.1759, -149.9901), ("ABQ", 35.0402, -106.6092),
    ("ONT", 34.0560, -117.6012), ("BUF", 42.9405, -78.7322), ("OAK", 37.7213, -122.2207),
    ("MEM", 35.0424, -89.9767), ("BDL", 41.9389, -72.6832), ("MKE", 42.9472, -87.8966),
    ("OMA", 41.3025, -95.8942), ("RNO", 39.4991, -119.7681), ("BOI", 43.5644, -116.2228),
    ("PVD", 41.7240, -71.4282), ("TUC", 32.1161, -110.9410), ("OKC", 35.3931, -97.6007),
    ("TUL", 36.1984, -95.8881), ("LIT", 34.7294, -92.2243), ("GEG", 47.6199, -117.5338),
    ("SYR", 43.1112, -76.1063), ("ROC", 43.1189, -77.6724), ("ALB", 42.7483, -73.8017),
    ("GRR", 42.8808, -85.5228), ("HSV", 34.6404, -86.7731), ("BUR", 34.2006, -118.3586),
    ("LGB", 33.8177, -118.1516), ("PSP", 33.8297, -116.5067), ("BFL", 35.4336, -119.0567),
    ("FAT", 36.7762, -119.7181), ("SDF", 38.1744, -85.7360), ("LEX", 38.0365, -84.6059),
    ("SAV", 32.1276, -81.2021), ("CHS", 32.8986, -80.0405), ("MYR", 33.6797, -78.9283),
    ("AMS", 52.3105, 4.7683), ("LHR", 51.4700, -0.4543), ("CDG", 49.0097, 2.5479),
    ("FRA", 50.0379, 8.5622), ("ICN", 37.4602, 126.4407), ("NRT", 35.7720, 140.3929),
    ("HND", 35.5494, 139.7798), ("PEK", 40.0799, 116.6031), ("PVG", 31.1443, 121.8083),
    ("HKG", 22.3080, 113.9185), ("SIN", 1.3644, 103.9915), ("BKK", 13.6900, 100.7501),
    ("DEL", 28.5562, 77.1000), ("BOM", 19.0896, 72.8656), ("DXB", 25.2532, 55.3657),
    ("DOH", 25.2609, 51.6138), ("SYD", -33.9461, 151.1772), ("MEL", -37.6690, 144.8410),
    ("YVR", 49.1967, -123.1815), ("YYZ", 43.6777, -79.6248), ("YUL", 45.4657, -73.7455),
    ("YYC", 51.1215, -114.0076), ("MEX", 19.4363, -99.0721), ("CUN", 21.0365, -86.8771),
    ("BOG", 4.7016, -74.1469), ("GRU", -23.4356, -46.4731), ("EZE", -34.8222, -58.5358),
    ("MAD", 40.4839, -3.5680), ("BCN", 41.2974, 2.0833), ("FCO", 41.8003, 12.2389),
    ("ZRH", 47.4582, 8.5555), ("VIE", 48.1103, 16.5697), ("MUC", 48.3537, 11.7860),
    ("ATH", 37.9364, 23.9472), ("IST", 41.2753, 28.7519), ("DUB", 53.4264, -6.2499),
)

# Carrier code of two letters (IATA), carrier code of three letters (ICAO).
CARRIERS = (
    ("DL", "DAL"), ("AA", "AAL"), ("UA", "UAL"), ("WN", "SWA"), ("B6", "JBU"),
    ("BA", "BAW"), ("F9", "FFT"), ("NK", "NKS"), ("AS", "ASA"), ("HA", "HAL"),
    ("AF", "AFR"), ("LH", "DLH"), ("AC", "ACA"), ("KL", "KLM"), ("AI", "AIC"),
    ("EK", "UAE"), ("QR", "QTR"), ("SQ", "SIA"), ("CX", "CPA"), ("KE", "KAL"),
    ("OZ", "AAR"), ("JL", "JAL"), ("NH", "ANA"), ("QF", "QFA"), ("NZ", "ANZ"),
    ("VS", "VIR"), ("TK", "THY"), ("TP", "TAP"), ("IB", "IBE"), ("AY", "FIN"),
    ("SK", "SAS"), ("OS", "AUA"), ("LX", "SWR"), ("EI", "EIN"), ("WS", "WJA"),
    ("AM", "AMX"), ("CM", "CMP"), ("AV", "AVA"), ("G3", "GLO"), ("AD", "AZU"),
    ("ET", "ETH"), ("SV", "SVD"), ("MS", "MSR"), ("CI", "CAL"), ("BR", "EVA"),
    ("MU", "CES"), ("CZ", "CSN"), ("HU", "CHH"), ("SG", "SEJ"), ("6E", "IGO"),
)

# Carrier code, full carrier name as the delay history spells it.
CARRIER_NAMES = (
    ("DL", "Delta Air Lines Inc."), ("AA", "American Airlines Inc."),
    ("UA", "United Air Lines Inc."), ("WN", "Southwest Airlines Co."),
    ("B6", "JetBlue Airways"), ("AS", "Alaska Airlines Inc."),
    ("NK", "Spirit Air Lines"), ("F9", "Frontier Airlines Inc."),
    ("HA", "Hawaiian Airlines Inc."), ("MQ", "Envoy Air"),
    ("YX", "Republic Airline"), ("OO", "SkyWest Airlines Inc."),
    ("OH", "PSA Airlines Inc."), ("YV", "Mesa Airlines Inc."),
    ("9E", "Endeavor Air Inc."), ("QX", "Horizon Air"), ("G4", "Allegiant Air"),
)

# Hub airports per carrier, in order; "*" is any other carrier.
HUBS = (
    ("DL", ("ATL", "DTW", "MSP", "SLC", "JFK", "SEA", "LAX")),
    ("AA", ("DFW", "CLT", "MIA", "PHL", "DCA", "LAX", "ORD")),
    ("UA", ("ORD", "IAH", "EWR", "DEN", "SFO", "LAX", "IAD")),
    ("WN", ("DAL", "MDW", "LAS", "BWI", "HOU", "PHX", "DEN")),
    ("B6", ("JFK", "BOS", "FLL", "MCO", "SJU")),
    ("AS", ("SEA", "PDX", "ANC", "LAX", "SFO")),
    ("*", ("ORD", "JFK", "LAX", "ATL", "DFW", "DEN", "SFO")),
)

# Airport code, city name for display.
CITIES = (
    ("ATL", "Atlanta"), ("ORD", "Chicago"), ("DFW", "Dallas"), ("DEN", "Denver"),
    ("JFK", "New York"), ("LAX", "Los Angeles"), ("SFO", "San Francisco"), ("SEA", "Seattle"),
    ("MIA", "Miami"), ("BOS", "Boston"), ("CLT", "Charlotte"), ("PHX", "Phoenix"),
    ("IAH", "Houston"), ("MCO", "Orlando"), ("EWR", "Newark"), ("MSP", "Minneapolis"),
    ("DTW", "Detroit"), ("PHL", "Philadelphia"), ("LGA", "New York"), ("BWI", "Baltimore"),
    ("SLC", "Salt Lake City"), ("SAN", "San Diego"), ("IAD", "Washington DC"), ("DCA", "Washington DC"),
    ("MDW", "Chicago"), ("TPA", "Tampa"), ("PDX", "Portland"), ("HNL", "Honolulu"),
    ("LAS", "Las Vegas"), ("BNA", "Nashville"), ("AUS", "Austin"), ("DAL", "Dallas"),
    ("STL", "St. Louis"), ("MSY", "New Orleans"), ("SMF", "Sacramento"), ("SJC", "San Jose"),
    ("SNA", "Orange County"), ("RDU", "Raleigh"), ("CLE", "Cleveland"), ("IND", "Indianapolis"),
    ("PIT", "Pittsburgh"), ("SAT", "San Antonio"), ("CVG", "Cincinnati"), ("CMH", "Columbus"),
    ("RSW", "Fort Myers"), ("PBI", "West Palm Beach"), ("JAX", "Jacksonville"), ("ANC", "Anchorage"),
    ("LHR", "London"), ("CDG", "Paris"), ("FRA", "Frankfurt"), ("HND", "Tokyo"),
    ("DXB", "Dubai"), ("SYD", "Sydney"), ("YYZ", "Toronto"), ("MEX", "Mexico City"),
    ("HOU", "Houston"),
)

# Position used when an airport is unknown.
UNKNOWN_LATITUDE = 39.82
UNKNOWN_LONGITUDE = -98.57

# Recommended action and its explanation for the four situations.
RECOMMENDATIONS = (
    (
        "programme",
        "ENFORCE ATC DELAY",
        "Option A: Proceed normally. This ignores the active NOTAM and risks severe federal penalties.\n\n"
        "Option B: Implement a minor delay. This does not fully account for the ATC delay penalty.\n\n"
        "Option C: Enforce the ATC delay penalty due to the active Ground Delay Program, overriding ML predictions.\n\n"
        "Decision: Option C is the recommended action due to the active Ground Delay Program, which mandates adherence to the ATC delay penalty.",
    ),
    (
        "inherited",
        "MONITOR SCHEDULE",
        "Option A: Increase cruise speed to recover lost time. This burns excess fuel.\n\n"
        "Option B: Maintain current routing and absorb the ground delay. This is standard procedure.\n\n"
        "Option C: Cancel the flight entirely.\n\n"
        "Decision: Option B is the recommended action. The delay is inherited from the ground, but current flight conditions are optimal.",
    ),
    (
        "at_risk",
        "IMPLEMENT DELAY",
        "Option A: Proceed normally. This ignores the high ML predicted risk.\n\n"
        "Option B: Implement the ML predicted delay to proactively manage the risk factors.\n\n"
        "Option C: Cancel the flight entirely.\n\n"
        "Decision: Option B is the recommended action to mitigate operational risk without requiring cancellation.",
    ),
    (
        "routine",
        "PROCEED NORMALLY",
        "Option A: Proceed normally as all operational parameters are within acceptable limits, with low weather risk and minimal predicted delay.\n\n"
        "Option B: Monitor for any unforeseen changes in weather or ATC status.\n\n"
        "Option C: Conduct a routine pre-flight briefing with the flight crew.\n\n"
        "Decision: Given the low weather risk, negligible predicted delay, and absence of active NOTAMs, proceeding normally is the most appropriate action.",
    ),
)

# Answer used when the outside model's reply leaves a field out.
DEFAULT_ACTION = "PROCEED NORMALLY"
DEFAULT_REASONING = (
    "Option A: Proceed normally.\n\nOption B: Monitor flight parameters.\n\n"
    "Option C: Prepare crew briefing.\n\nDecision: Proceed normally."
)

# Citations for the situations that need no search.
CITATION_ROUTINE = "No severe operational disruptions detected. Routine operations in effect."
CITATION_NO_CORPUS = (
    "FAA AC 00-45H - Aviation Weather Services. Severe weather requires alternate routing."
)
CITATION_NO_MATCH = "No relevant operational guidelines found for this route."
CITATION_INHERITED = (
    "FAA JO 7110.65 - Air Traffic Control. Ground delay inherited from prior flight legs."
)

# Airport programme texts.
NO_PROGRAMME_MESSAGE = "No active Air Traffic Control constraints at destination."

# Airport programmes by kind, with the texts around their reason and the minutes of those that state none.
GROUND_STOP = ("FAA GROUND STOP", "ATC GROUND STOP IN EFFECT: ", ". All inbound flights held at origin.", 120)
GROUND_DELAY = ("GROUND DELAY PROGRAM", "FAA GDP IN EFFECT: ", ". Arrival capacity reduced.", None)
ARRIVAL_DELAY = ("ATC ARRIVAL DELAY", "FAA METERING DELAY: ", ".", 30)
NO_PROGRAMME = ("None", None, None, 0)
UNKNOWN_REASON = "Unknown"

# Fixed value: what stands for readings that no one takes from a report.
UNREAD_REPORT = "Parsed from METAR (WIP)"

# Body of the report used for a station without one.
ROUTINE_REPORT = "AUTO 10SM CLR 22/15 A3000 RMK AO2 ROUTINE OPERATIONAL METAR"

# The model's 23 input columns, in order.
FEATURES = (
    "MONTH", "DAY", "DAY_OF_WEEK", "HOUR", "MINUTE", "TIME_OF_DAY", "SIN_TIME", "COS_TIME",
    "IS_RUSH_HOUR", "CONCURRENT_DELAYS_AT_ORIGIN", "IS_HOLIDAY", "IS_HOLIDAY_WEEK",
    "ORIGIN_PRECIP", "ORIGIN_WIND", "DEST_PRECIP", "DEST_WIND", "DISTANCE",
    "CRS_ELAPSED_TIME", "AIRLINE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT",
    "FLIGHT_NUMBER", "ROUTE",
)

# The readings of an airport that has no current weather document.
CALM_READINGS = {"code": 0.0, "temperature": 20.0, "wind": 8.0, "precipitation": 0.0}

# The five named scenarios; columns are those of FEATURES that vary.
SCENARIO_COLUMNS = (
    "name", "MONTH", "DAY", "DAY_OF_WEEK", "HOUR", "MINUTE", "IS_RUSH_HOUR",
    "CONCURRENT_DELAYS_AT_ORIGIN", "IS_HOLIDAY", "IS_HOLIDAY_WEEK", "ORIGIN_PRECIP",
    "ORIGIN_WIND", "DEST_PRECIP", "DEST_WIND", "DISTANCE", "CRS_ELAPSED_TIME", "AIRLINE",
    "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "FLIGHT_NUMBER",
)
SCENARIOS = (
    ("1. The Early Bird (Clear Weather, No Congestion)", 7, 23, 4, 7, 10, 1, 0.0, 0, 0, 0.0, 5.0, 0.0, 5.0, 2704.0, 335.0, "DL", "SFO", "BOS", "400"),
    ("2. The Rush Hour Thunderstorm", 7, 23, 4, 17, 30, 1, 45.0, 0, 0, 1.5, 30.0, 0.0, 5.0, 2475.0, 390.0, "AA", "JFK", "LAX", "100"),
    ("3. The Perfect Mid-Day Cruise", 7, 23, 4, 14, 0, 0, 5.0, 0, 0, 0.0, 5.0, 0.0, 5.0, 888.0, 150.0, "UA", "DEN", "ORD", "200"),
    ("4. The Holiday Cascade", 12, 23, 3, 19, 15, 1, 60.0, 0, 1, 0.0, 10.0, 0.0, 5.0, 990.0, 160.0, "WN", "MDW", "MCO", "500"),
    ("5. The Windy Destination", 7, 23, 4, 9, 0, 1, 10.0, 0, 0, 0.0, 5.0, 0.0, 35.0, 2704.0, 390.0, "B6", "BOS", "SFO", "300"),
)
