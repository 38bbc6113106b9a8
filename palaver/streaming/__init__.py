"""Extensions for streams; batch tables are the reference for their results."""
