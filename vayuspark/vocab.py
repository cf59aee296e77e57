"""Fixed vocabularies: pollutants, index breakpoints, labels, feature names, cities."""

from __future__ import annotations

# --- Fixed values: CPCB National Air Quality Index (2014) and the table layout -----------------
POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3"]
LABELS = {"pm25": "PM2.5", "pm10": "PM10", "no2": "NO2", "so2": "SO2", "co": "CO", "o3": "O3"}
WINDOW_HOURS = {"pm25": 24, "pm10": 24, "no2": 24, "so2": 24, "co": 8, "o3": 8}
INDEX_LEVELS = [0.0, 50.0, 100.0, 200.0, 300.0, 400.0, 500.0]
BREAKPOINTS = {
    "pm25": [0.0, 30.0, 60.0, 90.0, 120.0, 250.0, 380.0],
    "pm10": [0.0, 50.0, 100.0, 250.0, 350.0, 430.0, 600.0],
    "no2": [0.0, 40.0, 80.0, 180.0, 280.0, 400.0, 800.0],
    "so2": [0.0, 40.0, 80.0, 380.0, 800.0, 1600.0, 2100.0],
    "co": [0.0, 1.0, 2.0, 10.0, 17.0, 34.0, 50.0],
    "o3": [0.0, 50.0, 100.0, 168.0, 208.0, 748.0, 1000.0],
}
CATEGORIES = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor")]
TOP_CATEGORY = "Severe"
NO_DATA_CATEGORY = "Insufficient Data"
AVERAGES = {p: f"{p}_{WINDOW_HOURS[p]}h_avg" for p in POLLUTANTS}
SUB_INDICES = {p: f"sub_index_{p}" for p in POLLUTANTS}

WEATHER = [
    "temp_c", "humidity_pct", "wind_speed_ms", "wind_dir_deg",
    "precip_mm", "pressure_hpa", "boundary_layer_m", "radiation_wm2",
]
AIR = POLLUTANTS + ["dust", "aod"]
RAW = WEATHER + AIR

# Names in the hourly weather and air payloads -> our columns
WEATHER_NAMES = {
    "temperature_2m": "temp_c",
    "relative_humidity_2m": "humidity_pct",
    "wind_speed_10m": "wind_speed_ms",
    "wind_direction_10m": "wind_dir_deg",
    "precipitation": "precip_mm",
    "surface_pressure": "pressure_hpa",
    "boundary_layer_height": "boundary_layer_m",
    "shortwave_radiation": "radiation_wm2",
}
AIR_NAMES = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
    "ozone": "o3",
    "dust": "dust",
    "aerosol_optical_depth": "aod",
}

SATELLITE = ["no2", "so2", "co", "o3", "aod"]
SATELLITE_SCALE = {"no2": 1e6, "so2": 1e6, "co": 1e3, "o3": 1e3, "aod": 1.0}
MOLAR_MASS = {"no2": 46.005, "so2": 64.066, "co": 28.010, "o3": 47.997}

SENSITIVE_KEYS = ["password", "api_key", "token", "secret", "key_file", "credentials"]
REDACTED = "***REDACTED***"

LOOKBACK, HORIZON, HISTORY = 168, 24, 23
FILL_HOURS, PROXY_FILL_ROWS = 3, 2
RAW_DAYS, FORECAST_DAYS, VIEW_DAYS = 120, 30, 2
NEAREST_KM, DEDUPE_KM = 150.0, 25.0
COUNTRY_BOX = (6.0, 37.5, 68.0, 98.0)      # lat from, lat to, lon from, lon to: accepted places
GRID_BOX = (6.5, 37.5, 68.0, 97.5)         # lattice and [0, 1] scaling of coordinates
LOCAL_ZONE = "Asia/Kolkata"
INTERVAL = (0.10, 0.90)
PROMOTION_TOLERANCE = 1.02
CLOSE_AQI = 20

LOGGED = POLLUTANTS + ["dust"]
WEATHER_FEATURES = [
    "temp_c", "humidity_pct", "wind_u", "wind_v", "wind_speed_ms",
    "precip_log", "pressure_hpa", "blh_log", "radiation_wm2",
]
CALENDAR_FEATURES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos", "is_weekend"]
PAST_FEATURES = (
    [f"log_{c}" for c in LOGGED] + ["aod"] + WEATHER_FEATURES + CALENDAR_FEATURES + ["lat_norm", "lon_norm"]
)
FUTURE_FEATURES = WEATHER_FEATURES + CALENDAR_FEATURES
LAGS, ROLLS = [1, 3, 6, 24], [24, 168]
TABULAR_FEATURES = (
    PAST_FEATURES
    + [f"d_lag{k}_{p}" for k in LAGS for p in POLLUTANTS]
    + [f"d_roll{w}_{p}" for w in ROLLS for p in POLLUTANTS]
    + [f"d_yday_{p}" for p in POLLUTANTS]
    + [f"fut_{c}" for c in FUTURE_FEATURES]
    + ["horizon"]
)
PROXY_FEATURES = [
    "aod", "temp_c", "humidity_pct", "wind_speed_ms", "pressure_hpa", "boundary_layer_m",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
]
PROXY_DEFAULTS = {"boundary_layer_m": 1000.0, "pressure_hpa": 1013.25}
PROXY_LIMITS = {"pm25": 500.0, "pm10": 700.0}

# Members trained with Spark ML, in blend order, and the weights used when none were learnt
MEMBERS = ["huber", "gbt", "rf"]
DEFAULT_WEIGHTS = {"huber": 0.4, "gbt": 0.3, "rf": 0.3}

# Cities that are always nodes: name,state,lat,lon
CITIES_TEXT = """\
Delhi,Delhi,28.6139,77.2090
Noida,Uttar Pradesh,28.5355,77.3910
Ghaziabad,Uttar Pradesh,28.6692,77.4538
Gurugram,Haryana,28.4595,77.0266
Faridabad,Haryana,28.4089,77.3178
Chandigarh,Chandigarh,30.7333,76.7794
Ludhiana,Punjab,30.9010,75.8573
Amritsar,Punjab,31.6340,74.8723
Jalandhar,Punjab,31.3260,75.5762
Patiala,Punjab,30.3398,76.3869
Panipat,Haryana,29.3909,76.9635
Hisar,Haryana,29.1492,75.7217
Shimla,Himachal Pradesh,31.1048,77.1734
Dehradun,Uttarakhand,30.3165,78.0322
Haridwar,Uttarakhand,29.9457,78.1642
Srinagar,Jammu and Kashmir,34.0837,74.7973
Jammu,Jammu and Kashmir,32.7266,74.8570
Leh,Ladakh,34.1526,77.5771
Lucknow,Uttar Pradesh,26.8467,80.9462
Kanpur,Uttar Pradesh,26.4499,80.3319
Agra,Uttar Pradesh,27.1767,78.0081
Varanasi,Uttar Pradesh,25.3176,82.9739
Prayagraj,Uttar Pradesh,25.4358,81.8463
Meerut,Uttar Pradesh,28.9845,77.7064
Bareilly,Uttar Pradesh,28.3670,79.4304
Aligarh,Uttar Pradesh,27.8974,78.0880
Moradabad,Uttar Pradesh,28.8386,78.7733
Gorakhpur,Uttar Pradesh,26.7606,83.3732
Patna,Bihar,25.5941,85.1376
Gaya,Bihar,24.7914,85.0002
Muzaffarpur,Bihar,26.1209,85.3647
Bhagalpur,Bihar,25.2425,86.9842
Ranchi,Jharkhand,23.3441,85.3096
Jamshedpur,Jharkhand,22.8046,86.2029
Dhanbad,Jharkhand,23.7957,86.4304
Jaipur,Rajasthan,26.9124,75.7873
Jodhpur,Rajasthan,26.2389,73.0243
Kota,Rajasthan,25.2138,75.8648
Udaipur,Rajasthan,24.5854,73.7125
Bikaner,Rajasthan,28.0229,73.3119
Ajmer,Rajasthan,26.4499,74.6399
Ahmedabad,Gujarat,23.0225,72.5714
Gandhinagar,Gujarat,23.2156,72.6369
Surat,Gujarat,21.1702,72.8311
Vadodara,Gujarat,22.3072,73.1812
Rajkot,Gujarat,22.3039,70.8022
Bhavnagar,Gujarat,21.7645,72.1519
Jamnagar,Gujarat,22.4707,70.0577
Mumbai,Maharashtra,19.0760,72.8777
Thane,Maharashtra,19.2183,72.9781
Navi Mumbai,Maharashtra,19.0330,73.0297
Pune,Maharashtra,18.5204,73.8567
Nagpur,Maharashtra,21.1458,79.0882
Nashik,Maharashtra,19.9975,73.7898
Aurangabad,Maharashtra,19.8762,75.3433
Solapur,Maharashtra,17.6599,75.9064
Kolhapur,Maharashtra,16.7050,74.2433
Amravati,Maharashtra,20.9374,77.7796
Chandrapur,Maharashtra,19.9615,79.2961
Panaji,Goa,15.4909,73.8278
Bhopal,Madhya Pradesh,23.2599,77.4126
Indore,Madhya Pradesh,22.7196,75.8577
Gwalior,Madhya Pradesh,26.2183,78.1828
Jabalpur,Madhya Pradesh,23.1815,79.9864
Ujjain,Madhya Pradesh,23.1765,75.7885
Satna,Madhya Pradesh,24.6005,80.8322
Raipur,Chhattisgarh,21.2514,81.6296
Bhilai,Chhattisgarh,21.1938,81.3509
Korba,Chhattisgarh,22.3595,82.7501
Kolkata,West Bengal,22.5726,88.3639
Howrah,West Bengal,22.5958,88.2636
Asansol,West Bengal,23.6739,86.9524
Durgapur,West Bengal,23.5204,87.3119
Siliguri,West Bengal,26.7271,88.3953
Bhubaneswar,Odisha,20.2961,85.8245
Cuttack,Odisha,20.4625,85.8830
Rourkela,Odisha,22.2604,84.8536
Angul,Odisha,20.8400,85.1000
Guwahati,Assam,26.1445,91.7362
Dibrugarh,Assam,27.4728,94.9120
Shillong,Meghalaya,25.5788,91.8933
Agartala,Tripura,23.8315,91.2868
Imphal,Manipur,24.8170,93.9368
Aizawl,Mizoram,23.7271,92.7176
Kohima,Nagaland,25.6751,94.1086
Itanagar,Arunachal Pradesh,27.0844,93.6053
Gangtok,Sikkim,27.3389,88.6065
Hyderabad,Telangana,17.3850,78.4867
Warangal,Telangana,17.9689,79.5941
Visakhapatnam,Andhra Pradesh,17.6868,83.2185
Vijayawada,Andhra Pradesh,16.5062,80.6480
Amaravati,Andhra Pradesh,16.5131,80.5165
Guntur,Andhra Pradesh,16.3067,80.4365
Tirupati,Andhra Pradesh,13.6288,79.4192
Bengaluru,Karnataka,12.9716,77.5946
Mysuru,Karnataka,12.2958,76.6394
Mangaluru,Karnataka,12.9141,74.8560
Hubballi,Karnataka,15.3647,75.1240
Belagavi,Karnataka,15.8497,74.4977
Chennai,Tamil Nadu,13.0827,80.2707
Coimbatore,Tamil Nadu,11.0168,76.9558
Madurai,Tamil Nadu,9.9252,78.1198
Tiruchirappalli,Tamil Nadu,10.7905,78.7047
Salem,Tamil Nadu,11.6643,78.1460
Tirunelveli,Tamil Nadu,8.7139,77.7567
Thiruvananthapuram,Kerala,8.5241,76.9366
Kochi,Kerala,9.9312,76.2673
Kozhikode,Kerala,11.2588,75.7804
Thrissur,Kerala,10.5276,76.2144
Puducherry,Puducherry,11.9416,79.8083
Port Blair,Andaman and Nicobar Islands,11.6234,92.7265
Kavaratti,Lakshadweep,10.5667,72.6417
"""
# --- end of fixed values ------------------------------------------------------------------------

CITIES = [
    (name, state, float(lat), float(lon))
    for name, state, lat, lon in (line.split(",") for line in CITIES_TEXT.splitlines())
]
