"""Speech-transcript and speaker tables as Spark jobs."""
