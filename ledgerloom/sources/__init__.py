"""Where rows come from and go to: star-schema tables, dimensions, uploads, stores."""
