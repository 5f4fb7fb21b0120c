"""Edit-decision analytics as Spark jobs: timelines, signals, edit batches, event logs."""
