"""Where rows come from and go to: manifests, snapshots, golden files, and what a crawl may fetch."""
