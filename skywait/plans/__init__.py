"""Plans that combine operators: metric tables, views, SQL twins, pipeline stages."""
