"""freshet: Spark-native analytics for hourly sensor series, flood and landslide warning."""
