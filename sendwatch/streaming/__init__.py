from sendwatch.streaming.weekly import land_messages, start, weekly_counts  # noqa: F401
