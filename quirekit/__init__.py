"""quirekit: corpus-scale document segmentation, translation orchestration, checking and rebuild on Spark."""
