"""Layout search: jobs are independent, so each is decoded inside one task while Spark spreads the jobs."""
