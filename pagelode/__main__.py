from .plans.cli import main

raise SystemExit(main())
