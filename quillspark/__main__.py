from quillspark.plans.cli import main

raise SystemExit(main())
